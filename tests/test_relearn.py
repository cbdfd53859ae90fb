"""The learning loop: what arms are told, what they learn, and going on after a failure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermark.operators import boost, relearn
from ledgermark.operators.features import PAIR

RECORD = "record_id string, account string, amount_minor long, day int, label string, is_mult boolean"


@pytest.fixture(scope="module")
def world(spark):
    """Records whose right key is the nearest in days, while every candidate has the exact amount; the first ranker prefers the farthest."""
    rng = np.random.default_rng(6)
    records, pairs = [], []
    for r in range(240):
        gaps = rng.permutation(30)[:5]
        best = int(np.argmin(gaps))
        records.append((f"r{r:03}", "a", 50_000, r, f"k{best}", False))
        for k, gap in enumerate(gaps):
            x = dict.fromkeys(PAIR, 0.0) | {"amount_exact": 1.0, "date_gap_abs": float(gap), "n_candidates": 5.0}
            pairs.append((f"r{r:03}", f"k{k}", *[x[c] for c in PAIR]))
    records = spark.createDataFrame(records, RECORD)
    pairs = spark.createDataFrame(pairs, "record_id string, key string, " + ", ".join(f"{c} double" for c in PAIR))
    wrong = pairs.groupBy("record_id").agg(F.max_by("key", "date_gap_abs").alias("key"), F.lit(1).alias("is_label"))
    first = boost.fit_ranker(pairs.join(wrong, ["record_id", "key"], "left").fillna(0, ["is_label"]), trees=4, depth=2)
    return relearn.in_batches(records, 3), pairs, first


def test_batches(world):
    assert sorted((r["batch"], r["count"]) for r in world[0].groupBy("batch").count().collect()) == [(0, 80), (1, 80), (2, 80)]


def test_learns_and_goes_on(spark, world, tmp_path, monkeypatch):
    records, pairs, first = world
    calls, decide = [], relearn._judged

    def failing(here, rows, forests):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return decide(here, rows, forests)

    monkeypatch.setattr(relearn, "_judged", failing)
    with pytest.raises(RuntimeError, match="lost"):
        relearn.relearn(spark, records, pairs, first, str(tmp_path), trees=6)
    got = {(r["arm"], r["batch"]): r for r in relearn.relearn(spark, records, pairs, first, str(tmp_path), trees=6).collect()}
    assert len(calls) == 4  # the first batch isn't decided again
    assert len(got) == 12 and all(r["n"] == 80 for r in got.values())
    assert got["off", 0]["ranking"] > 70 and got["off", 2]["ranking"] > 70 and got["off", 2]["told"] == 0
    assert got["corrections", 0]["told"] == got["off", 0]["ranking"]
    right = {arm: got[arm, 2]["n"] - got[arm, 2]["ranking"] for arm in relearn.ARMS}
    assert right["corrections"] > 60 and right["placebo"] < 40
    again = {(r["arm"], r["batch"]): r for r in relearn.relearn(spark, records, pairs, first, str(tmp_path), trees=6).collect()}
    assert again == got


def test_told(spark):
    rows = [(arm, f"r{i}", "k1", locus, posted, mult) for arm in relearn.ARMS for i, (locus, posted, mult) in enumerate([("ranking", False, False), ("none", True, False), ("blocking", False, False), ("multiplicity", False, True), ("multiplicity", False, False), ("none", False, False)])]
    judged = spark.createDataFrame(rows, "arm string, record_id string, label string, locus string, posted boolean, is_mult boolean")
    cand = spark.createDataFrame([(f"r{i}", k) for i in range(6) for k in (["k1"] if i == 0 else ["k1", "k2"])], "record_id string, key string")
    got = {}
    for r in relearn.corrections(judged, cand, 1.0, 7).collect():
        got.setdefault(r["arm"], set()).add((r["record_id"], r["told"], r["weight"]))
    assert got == {"corrections": {("r0", "k1", 1.0), ("r4", "k1", 2.0)}, "spot_check": {("r0", "k1", 1.0), ("r1", "k1", 1.0), ("r4", "k1", 2.0)}, "placebo": {("r1", "k2", 1.0), ("r4", "k2", 2.0)}}


def test_no_records(spark, world, tmp_path):
    records, pairs, first = world
    assert relearn.relearn(spark, records.limit(0), pairs.limit(0), first, str(tmp_path)).count() == 0
