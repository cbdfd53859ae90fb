"""Embedding near-duplicates by E8 lattice hashing.

In each of ``tables`` tables a unit vector is projected at random to eight dimensions
and decoded to its nearest E8 point, which names its cell; it also probes the
``probes`` neighbouring cells (of 240) that lie nearest. Two vectors meet where one's
cell is the other's cell or probe, and are linked if their cosine in double precision
reaches ``least``. With the defaults (scale 0.8, 4 tables, 8 probes) a pair at cosine
0.95 meets in a table with probability 0.85, so 99.9 % of such pairs and more of the
nearer ones are found; the tests measure recall against brute force. Every row is
indexed and no cell is capped: cells of more than ``block`` rows are cut into blocks
that meet pairwise.

Equal vectors form one class and are never paired. A tile emits sums (how many vectors
each class links with) and a spanning forest of its links, never its pairs. A pair
that meets more than once counts in the first table, and there in one cell; this can
be seen from the two vectors, since cells come from integer arithmetic that no batch
size changes.

Cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are their own component; vectors of different lengths never link;
repeated rows are vectors of their own that link with each other; a null key counts as
a vector but is never the smallest; an empty table gives an empty result; extra
columns, labels included, are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import components, table, written
from ledgermark.llm.simhash import forest

SEED = 8
UNIT = float(1 << 20)  # components and projections are whole multiples of 1 / UNIT and 1 / 1024


@lru_cache
def minimal():
    """The 240 shortest vectors of E8."""
    import numpy as np

    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def nearest(x):
    """The nearest point of E8, the union of D8 and D8 shifted by a half."""
    import numpy as np

    def d8(x):
        r = np.rint(x)
        e = x - r
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        k = np.abs(e[odd]).argmax(axis=1)
        r[odd, k] += np.where(e[odd, k] >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache
def projection(dim: int, number: int, scale: float, seed: int):
    """Whole numbers (1024ths) of a random projection to eight dimensions, and its offset."""
    import numpy as np

    rng = np.random.default_rng([seed, dim, number])
    return np.rint(rng.standard_normal((dim, 8)) * scale * 1024), np.rint(rng.random(8) * 2 * 1024) / 1024


def cells(vectors, norms, number: int, scale: float, probes: int, seed: int):
    """int64 of shape (n, 1 + probes): each vector's own cell in a table, and those it probes."""
    import numpy as np

    dim = vectors.shape[1]
    matrix, offset = projection(dim, number, scale, seed)
    unit = np.rint(vectors / norms[:, None] * UNIT)
    x = unit @ matrix / (UNIT * 1024) + offset  # exact: sums of whole numbers below 2 ** 53
    own = nearest(x)
    near = (x - own) @ minimal().T
    order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    points = np.concatenate([own[:, None, :], own[:, None, :] + minimal()[order]], axis=1)
    h = np.full(points.shape[:2], np.uint64(dim << 32 | number << 8 | 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(8):
            h = (h ^ (2 * points[:, :, k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _vectors(raw):
    import numpy as np

    return np.stack([np.frombuffer(v, np.float64) for v in raw])


def _celled(tables: int, scale: float, probes: int, seed: int):
    def work(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for start in range(0, len(pdf), 1000):
                one = pdf.iloc[start : start + 1000]
                for dim, rows in one.groupby(one["vector"].map(len)):
                    v, norms = _vectors(rows["vector"]), rows["norm"].to_numpy()
                    for t in range(tables):
                        got = cells(v, norms, t, scale, probes, seed)
                        wide = 1 + probes
                        yield pd.DataFrame({"cell": got.ravel(), "own": np.tile(np.arange(wide) == 0, len(rows)), "number": np.full(got.size, t, np.int32), **{c: np.repeat(rows[c].to_numpy(), wide) for c in ("node", "n", "norm", "vector")}})

    return work


def _tile(least: float, tables: int, scale: float, probes: int, seed: int):
    def met(cx, cy):
        """Whether pairs of cell rows meet, and whether they meet as x probes y."""
        import numpy as np

        forward = np.zeros(len(cx), bool)
        back = np.zeros(len(cx), bool)
        for k in range(1, cx.shape[1]):
            forward |= cx[:, k] == cy[:, 0]
            back |= cy[:, k] == cx[:, 0]
        return (cx[:, 0] == cy[:, 0]) | forward | back, back

    def links(pdf):
        """A tile's rows -> index arrays of the pairs that count here."""
        import numpy as np

        v, norms, own, side = _vectors(pdf["vector"]), pdf["norm"].to_numpy(), pdf["own"].to_numpy(), pdf["side"].to_numpy()
        unit, number = v / norms[:, None], int(pdf["number"].iloc[0])
        known: list = []
        first = np.flatnonzero(own)
        for at in range(0, len(first), 512):
            i = first[at : at + 512]
            a, j = np.nonzero(unit[i] @ unit.T >= least)
            i = i[a]
            # in a tile of two blocks, only across them; two own rows are one pair
            ok = (i != j) & ((side[i] == 2) | (side[i] != side[j])) & (~own[j] | (i < j))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if not known:
                known += [cells(v, norms, t, scale, probes, seed) for t in range(number + 1)]
            for t in range(number):
                fresh = ~met(known[t][i], known[t][j])[0]
                i, j = i[fresh], j[fresh]
            here = known[number]
            # j probes i's cell; if i probes j's too, the smaller cell counts
            other = ~own[j] & met(here[j], here[i])[1] & (here[j, 0] < here[i, 0])
            yield i[~other], j[~other]

    def work(batches):
        import numpy as np
        import pandas as pd

        def out(pdf):
            for _, rows in pdf.groupby(["cell", "tile"], sort=False):
                if len(rows) < 2:
                    continue
                total, a, b = np.zeros(len(rows), np.int64), [], []
                n, node = rows["n"].to_numpy(), rows["node"].to_numpy()
                for i, j in links(rows):
                    np.add.at(total, i, n[j])
                    np.add.at(total, j, n[i])
                    keep = forest(i, j)
                    a.append(i[keep])
                    b.append(j[keep])
                if a:
                    some = np.flatnonzero(total)
                    a, b = np.concatenate(a), np.concatenate(b)
                    keep = forest(a, b)
                    yield pd.DataFrame({"a": node[some], "b": None, "n": total[some]})
                    yield pd.DataFrame({"a": node[a[keep]], "b": node[b[keep]], "n": 0})

        held = None
        for pdf in batches:
            pdf = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
            ends = (pdf["cell"] != pdf["cell"].iloc[-1]) | (pdf["tile"] != pdf["tile"].iloc[-1])
            cut = int(np.flatnonzero(ends.to_numpy())[-1]) + 1 if ends.any() else 0
            held = pdf.iloc[cut:]
            yield from out(pdf.iloc[:cut])
        if held is not None:
            yield from out(held)

    return work


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, least: float = 0.95, tables: int = 4, scale: float = 0.8, probes: int = 8, block: int = 1024, seed: int = SEED) -> DataFrame:
    """-> key, ``n_links``, ``component`` (the smallest key that links reach) and ``kept``."""
    x = F.col(vector).cast("array<double>")
    good = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0), F.lit(False))
    # scaled by a power of two, no square over- or underflows; cosines stay as they are
    peak = F.aggregate(x, F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v)))
    power = F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(peak)).cast("double"))))
    rows = vectors.select(F.col(key).alias("key"), F.when(good, F.transform(x, lambda v: v * power)).alias("x"))
    rows = written(rows.select("key", "x", F.md5(F.to_json(F.struct("x"))).alias("node")), "e8-rows")
    classes = rows.where("x is not null").groupBy("node", "x").agg(F.count("*").alias("n"), F.min("key").alias("least"))

    def bare(batches):
        import numpy as np

        for pdf in batches:
            pdf["norm"] = [float(np.sqrt(np.dot(v, v))) for v in pdf["x"]]
            pdf["vector"] = [np.asarray(v, np.float64).tobytes() for v in pdf["x"]]
            yield pdf[["node", "n", "least", "norm", "vector"]]

    classes = written(classes.mapInPandas(bare, "node string, n long, least long, norm double, vector binary"), "e8-classes")
    entries = classes.drop("least").mapInPandas(_celled(tables, scale, probes, seed), "cell long, own boolean, number int, node string, n long, norm double, vector binary")
    slim = classes.drop("least", "n").mapInPandas(_slim(tables, scale, probes, seed), "cell long, own boolean")
    sizes = written(slim.groupBy("cell").agg(F.count("*").alias("count"), F.count_if("own").alias("owns")).where("count > 1 and owns > 0").select("cell", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "e8-cells")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = entries.join(sizes, "cell").withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    dealt = met.select("cell", tile.alias("tile"), side.cast("int").alias("side"), "own", "number", "node", "n", "norm", "vector").repartition("cell", "tile").sortWithinPartitions("cell", "tile")
    found = written(dealt.mapInPandas(_tile(least, tables, scale, probes, seed), "a string, b string, n long"), "e8-links")
    counts = written(found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked")), "e8-counts")
    named = written(components(found.where("b is not null").select("a", "b"), "e8-cc").withColumnRenamed("component", "root"), "e8-components")
    owned = classes.select("node", "n", "least").join(counts, "node", "left").join(named, "node", "left").withColumn("root", F.coalesce("root", "node"))
    owned = written(owned, "e8-owned")
    smallest = written(owned.groupBy("root").agg(F.min("least").alias("component")), "e8-smallest")
    of = written(owned.join(smallest, "root").select("node", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"), "e8-classed")
    linked = rows.where("x is not null").select("key", "node").join(of, "node").select("key", "n_links", "component")
    alone = rows.where("x is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return linked.union(alone).select(F.col("key").alias(key), "n_links", "component", F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


def _slim(tables: int, scale: float, probes: int, seed: int):
    whole = _celled(tables, scale, probes, seed)

    def work(batches):
        for pdf in whole(b.assign(n=1) for b in batches):
            yield pdf[["cell", "own"]]

    return work


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_vectors(table(spark, sf_dir, "embeddings"))
    return got.select("vec_id", "n_links", F.col("component").cast("long").alias("component_id"), "kept")


#: Every pair compared; equal as long as no link is missed.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT vec_id, e, len(e) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.n = b.n AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, v.vec_id)::BIGINT AS component_id, v.vec_id = coalesce(c.component_id, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY 1) n ON n.a = v.vec_id LEFT JOIN (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1) c ON c.vec_id = v.vec_id
"""
