"""The case base: blocks, cells and pruning against plain loops; the state machine against the batch form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermark.operators import cases
from ledgermark.streaming import feed

ARRIVAL = "seq long, case_id string, locus string, situation array<double>"


def made(n, dims=4, loci=("a", "b", None), seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), f"c{i:05}", loci[int(rng.integers(len(loci)))], np.round(np.abs(rng.normal(size=dims)), 3).tolist()) for i in rng.permutation(n)]
    return [*rows, (n, "zero", "a", [0.0] * dims), (n + 1, "zero2", "a", [0.0] * dims), (n + 2, "none", "a", None), rows[0], rows[0]]


def plain(rows, duplicate, most):
    """One arrival after the other, all kept cases looked at."""
    out = []
    for locus in {r[2] for r in rows}:
        held, turn = [], 0
        for _, case_id, _, v in sorted((r for r in rows if r[2] == locus and r[3] is not None), key=lambda r: (r[0], r[1])):
            v = np.array(v)
            norm = np.linalg.norm(v)
            hit = next((h for h in held if norm and np.linalg.norm(h["v"]) and h["v"] @ v / np.linalg.norm(h["v"]) / norm >= duplicate), None)
            if hit:
                hit["n"] += 1
                continue
            held.append({"id": case_id, "v": v, "n": 0, "turn": (turn := turn + 1)})
            if len(held) > most:
                held.remove(min(held, key=lambda h: (h["n"], h["turn"])))
        out += [(locus, h["id"], h["n"]) for h in held]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("most", "block", "duplicate"), [(1000, 7, 0.95), (1000, 4096, 0.9), (20, 16, 0.97)])
def test_retain(spark, most, block, duplicate):
    rows = made(400)
    got = cases.retain(spark.createDataFrame(rows, ARRIVAL).repartition(3), duplicate, most, block)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, duplicate, most)


def test_retain_of_long_vectors_in_tiles(spark, monkeypatch):
    """Arrivals that are mostly unlike meet what is kept tile by tile."""
    monkeypatch.setattr(cases, "TILE", 50)
    rng = np.random.default_rng(4)
    rows = [(i, f"c{i:05}", "ab"[i % 2], rng.normal(size=64).tolist()) for i in range(700)]
    rows += [(700 + i, f"c{700 + i:05}", "ab"[i % 2], (np.array(rows[3 * i][3]) + 0.1 * rng.normal(size=64)).tolist()) for i in range(200)]
    got = cases.retain(spark.createDataFrame(rows, ARRIVAL).repartition(3), 0.95, 1000, 128)
    want = plain(rows, 0.95, 1000)
    assert sorted(map(tuple, got.collect()), key=repr) == want and 700 <= len(want) < 900


def test_unit_takes_the_length_once(spark):
    plan = spark.range(1).select(cases.unit(F.array(F.lit(3.0), F.col("id") + 4.0)).alias("u"))
    assert plan.first().u == [0.6, 0.8]
    text = plan._jdf.queryExecution().analyzed().toString()
    assert text.index("SQRT") < text.index("lambdafunction(CASE WHEN"), "the length is inside of the loop over components"


def test_retain_empty_and_hot(spark):
    assert cases.retain(spark.createDataFrame([], ARRIVAL)).count() == 0
    hot = spark.range(20_000).select(F.col("id").alias("seq"), F.concat(F.lit("c"), "id").alias("case_id"), F.lit("l").alias("locus"), F.array(F.lit(1.0), F.rand(3) / 100).alias("situation"))
    assert [tuple(r) for r in cases.retain(hot, block=64).collect()] == [("l", "c0", 19_999)]


@pytest.mark.parametrize("least", [0.97, 0.85, 0.3, -1.0])
def test_retrieve(spark, least):
    rows = [r for r in made(300, seed=5) if r[3] is not None]
    df = spark.createDataFrame(rows, ARRIVAL).dropDuplicates(["case_id"])
    held = df.withColumn("retired", F.col("seq") % 7 == 0)
    asked = df.where("seq % 5 = 0").withColumnRenamed("case_id", "query_id")
    got = cases.retrieve(asked, held, 3, least, F.col("query_id") != F.col("case_id"), pivots=4)
    want = []
    plain_rows = {r["case_id"]: r for r in df.collect()}

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    for q in plain_rows.values():
        if q["seq"] % 5 == 0 and q["locus"] is not None:
            found = [(-round(cosine(q["situation"], c["situation"]), 9), c["case_id"]) for c in plain_rows.values() if c["locus"] == q["locus"] and c["seq"] % 7 and c["case_id"] != q["case_id"]]
            want += [(q["case_id"], c, r) for r, (s, c) in enumerate(sorted(x for x in found if -x[0] >= least)[:3], 1)]
    assert sorted((r["query_id"], r["case_id"], r["rank"]) for r in got.collect()) == sorted(want)


def test_retrieve_compares_few(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 6))
    rows = [(i, f"c{i}", "l", (centres[i % 40] + rng.normal(size=6) * 0.1).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, ARRIVAL)
    seen = []
    got = cases.retrieve(df.where("seq % 10 = 0").withColumnRenamed("case_id", "query_id"), df.withColumn("retired", F.lit(False)), compared=seen.append)
    assert got.count() == 1000
    assert seen[0] < 0.2 * 200 * 2000


def test_retrieve_equal_vectors_grow_in_line(spark):
    """Copies of the cases, under ids of their own, add no comparisons, and ties by rounding go by id."""
    rng = np.random.default_rng(4)
    base = np.round(np.abs(rng.normal(size=(300, 4))), 3)
    counts = []
    for copies in (1, 8):
        df = spark.createDataFrame([(c * 300 + i, f"c{c * 300 + i:05}", "l", v.tolist()) for c in range(copies) for i, v in enumerate(base)], ARRIVAL)
        seen = []
        got = cases.retrieve(df.where("seq % 20 = 0").withColumnRenamed("case_id", "query_id"), df.withColumn("retired", F.lit(False)), compared=seen.append, own=False, digits=9).collect()
        counts.append(seen[0])
        units = base / np.linalg.norm(base, axis=1)[:, None]
        sims = np.tile(units @ units.T, (1, copies))
        for q in range(0, 300 * copies, 20):
            best = sorted((-round(s, 9), c) for c, s in enumerate(sims[q % 300]) if c != q and s >= 0.85)[:5]
            assert sorted((r["rank"], r["case_id"]) for r in got if r["query_id"] == f"c{q:05}") == [(n, f"c{c:05}") for n, (_, c) in enumerate(best, 1)]
    assert counts[1] <= 2 * counts[0]


def test_retrieve_compares_in_line_where_cases_lie_dense(spark):
    """Eight times as many distinct cases and queries: a query meets little more of them than before."""
    rng = np.random.default_rng(6)
    counts = []
    for n in (3000, 24_000):
        v = np.column_stack([np.log10(rng.uniform(900, 105_000, n)), rng.integers(1, 51, n) / 10, rng.integers(0, 11, n) / 2, rng.integers(0, 9, n) * 0.6])
        df = spark.createDataFrame([(i, f"c{i:05}", "l", x.tolist()) for i, x in enumerate(v)], ARRIVAL)
        seen = []
        got = cases.retrieve(df.where("seq % 20 = 0").withColumnRenamed("case_id", "query_id"), df.withColumn("retired", F.lit(False)), compared=seen.append, own=False, digits=9).collect()
        counts.append(seen[0])
        units = v / np.linalg.norm(v, axis=1)[:, None]
        want = []
        for q in range(0, n, 20):
            sims = units @ units[q]
            best = sorted((-round(sims[c], 9), c) for c in np.argsort(-sims)[:20] if c != q and sims[c] >= 0.85)[:5]
            want += [(f"c{q:05}", r, f"c{c:05}") for r, (_, c) in enumerate(best, 1)]
        assert sorted((r["query_id"], r["rank"], r["case_id"]) for r in got) == want
    assert counts[1] <= 13 * counts[0]


def streamed(spark, parts, path, most=50_000, duplicate=0.95):
    """One file and one run for each part; every run goes on from the checkpoint of the last."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        feed.retain_feed(stream, duplicate, most).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("locus string, seq long, case_id string, event string").parquet(f"{path}/out")


@pytest.mark.parametrize("most", [50_000, 15])
def test_stream_goes_on_after_a_stop(spark, tmp_path, most):
    rows = sorted({r[1]: r for r in made(200, seed=3)}.values(), key=lambda r: r[0])
    parts = [spark.createDataFrame(rows[a : a + 80], ARRIVAL) for a in (0, 80, 160)]
    events = streamed(spark, parts, tmp_path, most)
    if most > 1000:
        assert sorted(map(tuple, feed.kept_cases(events).collect()), key=repr) == plain(rows, 0.95, most)
    else:
        assert sorted(((r["locus"], r["case_id"]) for r in feed.kept_cases(events).collect()), key=repr) == [(locus, c) for locus, c, _ in plain(rows, 0.95, most)]
