"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source is wanted ``target / source size`` times. The whole part is
taken outright; the fraction is rounded by weighted pivotal steps (Gandhi, Khuller,
Parthasarathy and Srinivasan, 2006; Deville and Tille, 1998): two fractional rows
trade mass (size times fraction) at random, with probabilities that keep each row's
expectation, until one is integral. The steps keep a source's mass exactly, so only
the last residual of a source moves its words away from the target, by less than
that row's size.

Rows meet in a reduction tree of each source: leaves of about ``leaf`` rows, chosen by a hash
of key, text and number among equal rows, leave one residual each; residuals of ``leaf``
leaves meet in the next level, and so on. A source's tree is as high as its own rows need.
Tasks take bins of several leaves, so that many small sources are as cheap as few large
ones. Randomness is a hash of seed, level and key, so reruns and other partitionings agree.

Cases: a null text has size 0; rows of size 0 are taken ``floor(ratio)`` times (they
carry no mass); a null source is a source of its own, ordered last; a null key is an
ordinary key; repeated rows are units of their own; an empty table gives an empty
result. Extra columns do not matter, only ``key``, ``source`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermark.llm.common import WORD, table, written
from ledgermark.llm.lines import boxed, whole

SEED = 20_260_101
WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)``, one row a source -> with ``target``.

    Sources in code-point order, null last, take the weights in turn. The budget is
    ``share`` of all sizes; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight until none is above. The order is a range
    partitioning with counts per partition, and each round of sharing is one
    aggregate, so the number of sources is not bounded by a task.
    """
    part = written(
        sizes.withColumn("last", F.col("source").isNull().cast("int")).repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()),
        "mix-order",
    )
    firsts = part.groupBy("part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    # as many rows as partitions, which the cluster sets and the data does not
    before = firsts.alias("x").join(F.broadcast(firsts.alias("y")), F.col("y.part") < F.col("x.part"), "left").groupBy("x.part", "x.first").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    turn = F.pmod(F.col("row") - F.col("first") + F.col("before"), F.lit(len(weights))).cast("int")
    weighed = written(
        part.join(F.broadcast(before), "part").select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")),
        "mix-weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget, level, full = share * total, 0.0, -1
    while total:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        capped, weight, n = weighed.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if n == full or not weight:
            break
        full, level = n, (budget - capped) / weight
    return weighed.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _draw(seed: int, level: int, doc_id, size: int, turn: int) -> float:
    import hashlib

    return int.from_bytes(hashlib.blake2b(f"{seed}|{level}|{doc_id}|{size}|{turn}".encode(), digest_size=8).digest(), "big") / 2**64


def pivot(rows: list, seed: int, level: int):
    """Weighted pivotal rounding of one source's ``[key, size, fraction, base, ...]`` rows in order.

    Returns the rows with their fraction 0.0 or 1.0, and the residual row or None.
    """
    done, held = [], None
    for turn, row in enumerate(rows):
        if not 0.0 < row[2] < 1.0 or row[1] == 0:
            row[2] = 1.0 if row[2] >= 1.0 else 0.0
            done.append(row)
            continue
        if held is None:
            held = row
            continue
        x, y = held, row
        up = min((1.0 - x[2]) * x[1], y[2] * y[1])  # mass that can go from y to x
        down = min(x[2] * x[1], (1.0 - y[2]) * y[1])  # and from x to y
        if _draw(seed, level, y[0], y[1], turn) * (up + down) < down:
            mass = up
        else:
            mass = -down
        x[2] += mass / x[1]
        y[2] -= mass / y[1]
        for row in (x, y):
            if min(row[2], 1.0 - row[2]) < 1e-9:
                row[2] = float(round(row[2]))
        left = [r for r in (x, y) if 0.0 < r[2] < 1.0]
        done += [r for r in (x, y) if not 0.0 < r[2] < 1.0]
        held = left[0] if left else None
        if len(left) == 2:  # both a hair from integral: the smaller one yields
            left.sort(key=lambda r: r[1])
            left[0][2] = float(round(left[0][2]))
            done.append(left[0])
            held = left[1]
    return done, held


def _leaves(seed: int, level: int):
    """Rounds each (source, leaf) of a bin by itself; where it is the source's only leaf, its residual too."""

    def work(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["source", "leaf", "size", "k", "h", "nth"], ascending=[True, True, False, True, True, True], na_position="last", kind="stable").reset_index(drop=True)
        source = pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        leaf, size, fraction = pdf["leaf"].to_numpy(), pdf["size"].tolist(), pdf["fraction"].to_numpy().copy()
        last, key, done = (pdf["leaves"] == 1).tolist(), pdf["k"].tolist(), np.ones(len(pdf), bool)
        starts = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (leaf[1:] != leaf[:-1])]).tolist()
        for i, j in zip(starts, [*starts[1:], len(pdf)], strict=True):
            rows, held = pivot([[key[x], size[x], float(fraction[x]), x] for x in range(i, j)], seed, level)
            if held is not None:
                if last[i]:
                    held[2] = 1.0 if _draw(seed, -1, held[0], held[1], 0) < held[2] else 0.0
                else:
                    done[held[3]] = False
                rows.append(held)
            for r in rows:
                fraction[r[3]] = r[2]
        return pdf.assign(fraction=fraction, done=done)[[c.split()[0] for c in ROW.split(", ")]]

    return work


ROW = "k string, source string, size long, h long, nth long, source_size long, target double, base long, leaf long, leaves long, fraction double, done boolean"


def repeated(rows: DataFrame, n: str, nth: str, block: int = 65_536) -> DataFrame:
    """Each row ``n`` times, numbered from 0 as ``nth``; in two steps, so that no array holds more than a block or n / block numbers."""
    blocks = rows.withColumn("_b", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {block})")))
    return blocks.withColumn(nth, F.explode(F.expr(f"sequence(_b * {block}, least({n}, (_b + 1) * {block}) - 1)"))).drop("_b", n)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = SEED, leaf: int = 256, per_bin: int = 16) -> DataFrame:
    """-> ``(key, h, source, size, source_size, target, copies)``, ``h`` a hash of the text, one row for each row of ``docs``.

    ``per_bin`` leaves, of whatever sources, make one group of some ``leaf * per_bin`` rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(key).cast("string").alias("k"), F.col(source).alias("source"), size.alias("size"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("h"))
    # equal rows are counted, and told apart by number from here on
    slim = written(slim.groupBy("k", "source", "size", "h").agg(F.count("*").alias("m")), "mix-sizes")
    sums = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    sums = written(sums, "mix-sums")
    aim = targets(sums.select("source", "source_size"), weights, share, most).alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
    aim = written(aim.select("t.*", F.ceil(F.col("s.n") / leaf).cast("long").alias("leaves")), "mix-targets")
    at = slim.alias("d").join(aim.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t.leaves")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = repeated(at, "m", "nth").withColumn("base", F.floor(ratio).cast("long")).withColumn("fraction", ratio - F.floor(ratio))
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed), "k", "size", "h", "nth"), F.col("leaves")))
    n, level, done = sums.agg(F.sum("n")).first()[0] or 0, 0, []
    while True:
        bins = max(1, -(-n // (leaf * per_bin)))
        got = written(rows.withColumn("bin", F.pmod(F.xxhash64("source", "leaf"), F.lit(bins))).groupBy("bin").applyInPandas(_leaves(seed, level), ROW), "mix-level")
        done.append(got.where("done"))
        n, level = got.where("not done").count(), level + 1
        if not n:
            break
        # residuals of a source's neighbouring leaves meet: at most one for each, so at most ``leaf`` in a leaf
        rows = got.where("not done").drop("done").withColumn("leaf", F.expr(f"leaf div {leaf}")).withColumn("leaves", F.expr(f"(leaves + {leaf - 1}) div {leaf}"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(F.col("k").cast(docs.schema[key].dataType).alias("key"), "h", "source", "size", "source_size", "target", (F.col("base") + F.col("fraction").cast("long")).alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as many times as :func:`mix` takes it.

    Rows that share key and text are numbered, and the numbered copies meet.
    """
    rows = boxed(docs, key, text)
    same = Window.partitionBy("k", "h")
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy(F.xxhash64("box"))))
    taken = mix(docs, key, source, text, **options).where("copies > 0").select(F.col("key").alias("mk"), F.col("h").alias("mh"), "copies")
    taken = written(taken.withColumn("m", F.row_number().over(Window.partitionBy("mk", "mh").orderBy("copies"))), "mix-taken")
    both = rows.join(taken, F.col("k").eqNullSafe(F.col("mk")) & (F.col("h") == F.col("mh")) & (F.col("nth") == F.col("m")))
    return both.select(whole().alias("row"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
