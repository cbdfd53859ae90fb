"""Who a written name is: a cascade of layers, each asked only about what those before it left open.

``identifier``, an equal hard identifier; ``exact``, an equal name without case, marks and
legal forms; ``fuzzy``, the most similar name by sets of three letters; ``alias``, a trusted
alias of the registry; ``none``. A layer that finds more than one entity answers
``ambiguous`` without an entity, as a wrong entity is worse than none, and ends the search.

Names are asked about once however many rows have them. The fuzzy layer is exact: names
whose similarity reaches ``least`` share two of their rarest groups of letters, and only such
pairs are compared. Layers are anti joins over written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed

#: Words that say a company's legal form.
FORMS = ("limited", "ltd", "private", "pvt", "llp", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "gmbh", "plc")

#: Words of 64 bits that tell names apart before they are compared.
WORDS = 2


def normalised(name: Column) -> Column:
    """A name in small letters without marks and legal forms; dots join letters, other marks part words. May be empty."""
    words = F.split(F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("."), F.lit("")), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*FORMS)), " ")


def grams(name: Column) -> Column:
    """The set of groups of three letters of a name, with a space on both its sides; none of an empty name."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))))


def similar(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs ``(left, right, similarity)`` of ``left(name)`` and ``right(name)``, distinct normalised names, with a Jaccard similarity of at least ``least``.

    Partners with n and m groups share ``least / (1 + least) * (n + m)`` or more. Groups with a
    space and those without meet only their like, so the shapes of names, how many of each they
    have, tell which names have a partner at all, and t, the fewest groups one shares with any.
    Groups that only one side has are never shared. The others, v of a name, are ordered by how
    many names have them, rarest first; if t is two at least, two shared ones are among the first
    v - t + 2 of either, so names meet by pairs of groups, of which there are many more than
    groups. Only names that may share a single group meet by one. Bits of the groups tell most of
    those apart that meet by chance; names travel as numbers, and only pairs left are compared.
    """
    share = least / (1 + least)
    sides = []
    for d in (left, right):
        at = d.select("name", grams(F.col("name")).alias("grams")).where(F.size("grams") > 0)
        at = at.select(F.monotonically_increasing_id().alias("id"), "name", "grams", F.size("grams").alias("n"), F.size(F.filter("grams", lambda x: F.contains(x, F.lit(" ")))).alias("edge"))
        sides.append(checkpointed(at))
    # at most as many shapes as there are pairs of counts in a name
    shapes = [checkpointed(s.select(F.col("n").alias(f"n{i}"), F.col("edge").alias(f"edge{i}")).distinct()) for i, s in enumerate(sides)]
    # a hair less, so that rounding never shortens what is looked at
    needed = F.greatest(F.lit(1), F.ceil((F.col("n0") + F.col("n1")) * F.lit(share) - 1e-9).cast("int"))
    fits = shapes[0].crossJoin(shapes[1]).withColumn("t", needed).where(F.least("edge0", "edge1") + F.least(F.col("n0") - F.col("edge0"), F.col("n1") - F.col("edge1")) >= F.col("t"))
    fits = checkpointed(fits)
    sides = [s.join(fits.groupBy(F.col(f"n{i}").alias("n"), F.col(f"edge{i}").alias("edge")).agg(F.min("t").alias("t")), ["n", "edge"]) for i, s in enumerate(sides)]
    known = [s.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias(f"c{i}")) for i, s in enumerate(sides)]
    rare = checkpointed(known[0].join(known[1], "gram").select("gram", (F.col("c0") + F.col("c1")).alias("c")))
    words = [f"b{w}" for w in range(WORDS)]

    def heads(side):
        every = side.select("id", "n", "t", F.explode("grams").alias("gram")).join(rare, "gram").groupBy("id", "n", "t").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("g"))
        return every.where(F.size("g") >= F.col("t")).select("id", "n", "t", F.transform("g", lambda x: F.xxhash64(x["gram"])).alias("g")).mapInArrow(_signs, f"id bigint, n int, {', '.join(f'{w} bigint' for w in words)}, sign bigint")

    a, b = heads(sides[0]).alias("a"), heads(sides[1]).alias("b")
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    apart = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words[1:]), F.bit_count(F.col("a.b0").bitwiseXOR(F.col("b.b0"))))
    # signs are far more than what is read of names, by which Spark would send one side to the driver
    met = a.join(b.hint("merge"), (F.col("a.sign") == F.col("b.sign")) & (small >= large * least - 1e-9) & (apart <= (F.col("a.n") + F.col("b.n")) * ((1 - least) / (1 + least)) + 1e-9))
    met = met.select(F.col("a.id").alias("_a"), F.col("b.id").alias("_b")).distinct()
    met = met.join(sides[0].select(F.col("id").alias("_a"), F.col("name").alias("left")), "_a").join(sides[1].select(F.col("id").alias("_b"), F.col("name").alias("right")), "_b")
    met = met.select("left", "right", grams(F.col("left")).alias("_a"), grams(F.col("right")).alias("_b")).withColumn("_s", F.size(F.array_intersect("_a", "_b")))
    ratio = F.col("_s") / (F.size("_a") + F.size("_b") - F.col("_s"))
    return met.select("left", "right", ratio.alias("similarity")).where(F.col("similarity") >= least)


def _signs(batches):
    """Names with their groups ``g`` as hashes, rarest first -> a row for each pair of groups in the head, or for each group where one may be all that is shared."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n, t = (batch.column(c).to_numpy() for c in ("id", "n", "t"))
        v = batch.column("g").value_lengths().to_numpy().astype(np.int64)
        g = batch.column("g").flatten().to_numpy().view(np.uint64)
        first = np.cumsum(v) - v
        place = g % np.uint64(64 * WORDS)
        bit = np.uint64(1) << (place % np.uint64(64))
        bits = [np.bitwise_or.reduceat(np.where(place // np.uint64(64) == w, bit, np.uint64(0)), first).view(np.int64) for w in range(WORDS)]

        def table(rows, signs):
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(x[rows], signs.shape[1])) for x in (ids, n, *bits)] + [pa.array(signs.ravel().view(np.int64))], names=["id", "n", *[f"b{w}" for w in range(WORDS)], "sign"])

        head = np.where(v > 1, v - np.maximum(t, 2) + 2, 0)
        for size in np.unique(head[head > 1]):
            i, j = np.triu_indices(size, 1)
            every, step = np.flatnonzero(head == size), max(1, 1_000_000 // len(i))
            for lo in range(0, len(every), step):
                rows = every[lo : lo + step]
                at = g[first[rows][:, None] + np.arange(size)]
                for some in range(0, len(i), 1_000_000):
                    few = slice(some, some + 1_000_000)
                    yield table(rows, at[:, i[few]] * np.uint64(0x9E3779B97F4A7C15) + at[:, j[few]])
        for size in np.unique(v[t < 2]):
            rows = np.flatnonzero((t < 2) & (v == size))
            yield table(rows, g[first[rows][:, None] + np.arange(size)])


def trusted(aliases: DataFrame, confirmations: int = 3) -> DataFrame:
    """``aliases(alias, entity_id, evidence, confirmations, contradictions)`` that may be acted on.

    Any contradiction retires one; hard identifiers and people are believed at once, joint
    occurrences after ``confirmations``, a model's proposals never.
    """
    sure = F.col("evidence").isin("gstin", "cin", "human") | ((F.col("evidence") == "cooccurrence") & (F.col("confirmations") >= confirmations))
    return aliases.where(sure & (F.coalesce("contradictions", F.lit(0)) == 0))


def resolve(parties: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.6, confirmations: int = 3) -> DataFrame:
    """``parties(name, identifier)``, ``entities(entity_id, canonical_name, identifier)`` -> ``name, identifier, entity_id, layer, similarity``, a row for each distinct name and identifier.

    Null and empty identifiers are none; a name of nothing but marks and legal forms is
    found by its identifier or not at all. The similarity is that of the fuzzy layer.
    """
    own = F.when(F.col("identifier") != "", F.col("identifier")).alias("identifier")
    left = checkpointed(parties.select("name", own).distinct().withColumn("norm", normalised(F.col("name"))))
    known = checkpointed(entities.select("entity_id", own, normalised(F.col("canonical_name")).alias("norm")).distinct())

    def one(by: DataFrame, column: str) -> DataFrame:
        """A row for each value of ``column``: its entity, or null where it has several."""
        least_, most_ = F.min("entity_id"), F.max("entity_id")
        return by.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.when(least_ == most_, least_).alias("entity_id"), F.lit(True).alias("_hit"))

    done = []

    def layer(rows: DataFrame, found: DataFrame, column: str, name: str, similarity: Column | None = None) -> DataFrame:
        got = checkpointed(rows.join(found, column, "left"))
        hit = got.where("_hit")
        done.append(hit.select("name", "identifier", "entity_id", F.when(F.col("entity_id").isNull(), "ambiguous").otherwise(name).alias("layer"), (similarity if similarity is not None else F.lit(None).cast("double")).alias("similarity")))
        return got.where("_hit is null").select("name", "identifier", "norm")

    open_ = layer(left, one(known, "identifier"), "identifier", "identifier")
    open_ = layer(open_, one(known, "norm"), "norm", "exact")
    asked = open_.select(F.col("norm").alias("name")).distinct()
    pairs = checkpointed(similar(asked, known.select(F.col("norm").alias("name")).distinct(), least))
    best = pairs.groupBy(F.col("left").alias("norm")).agg(F.max("similarity").alias("similarity"))
    # of all that are as similar as the best; a name of several entities is no answer either
    tied = pairs.withColumnRenamed("left", "norm").join(best, ["norm", "similarity"]).join(known.select(F.col("norm").alias("right"), "entity_id"), "right")
    found = one(tied.select("norm", "entity_id"), "norm").join(best, "norm")
    open_ = layer(open_, found, "norm", "fuzzy", F.col("similarity"))
    names = trusted(aliases, confirmations).select(normalised(F.col("alias")).alias("norm"), "entity_id")
    open_ = layer(open_, one(names, "norm"), "norm", "alias")
    out = open_.select("name", "identifier", F.lit(None).cast(entities.schema["entity_id"].dataType).alias("entity_id"), F.lit("none").alias("layer"), F.lit(None).cast("double").alias("similarity"))
    for d in done:
        out = out.unionByName(d)
    return out
