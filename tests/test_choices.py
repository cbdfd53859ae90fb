"""Ranking of two best, runs without a ranker, leakage of all columns at once, placebos."""

import pytest
from pyspark.sql import functions as F

from ledgermark.operators import evaluate, learn, rank
from ledgermark.operators.audit import Trail
from ledgermark.plans import run
from ledgermark.plans.queries import View
from tests.conftest import DATA


def test_best_two_equals_ranked(spark):
    x = View(spark, DATA)
    scored = x.scored()
    cols = ["record_id", "n", "key", "score", "margin", "ranked_keys"]
    assert sorted(map(tuple, rank.best_two(scored).select(cols).collect())) == sorted(map(tuple, rank.ranked(scored).select(cols).collect()))
    plan = rank.best_two(scored).select("key", "margin")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_unknown_keys_make_unscorable_records(spark):
    x = View(spark, DATA)
    x.stats = lambda: x.__class__.stats(x).where("false")
    got = {r["outcome"]: r["count"] for r in x.decisions().groupBy("outcome").count().collect()}
    blocked = x.cand().select("record_id").distinct().count()
    assert got == {"unscorable": blocked, "no_candidate": x.bank.count() - blocked}


def test_a_missing_bundle_queues_every_record(spark, tmp_path):
    x, trail = View(spark, DATA), Trail(spark, str(tmp_path / "t"))
    run_id, _ = run.run_batch(x.bank, x.ledger, trail, "someone", bundle_path=str(tmp_path / "nothing"))
    assert trail.status(run_id) == "completed"
    paths = {(r["outcome"], r["path"]) for r in run.plan(x.bank, x.ledger, rules=False).select("outcome", "path").distinct().collect()}
    assert paths == {("queued", "no_ranker")}
    spark.createDataFrame([("not a manifest",)], "value string").write.text(str(tmp_path / "bad" / "manifest"))
    with pytest.raises(ValueError):
        run.Bundle.found(spark, str(tmp_path / "bad"))


def test_leakage_of_all_columns(spark):
    df = spark.range(400).select((F.col("id") % 2 == 0).alias("y"), F.when(F.col("id") % 2 == 0, "a").alias("same"), (F.col("id") % 3).cast("string").alias("other"), F.lit("c").alias("one"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 10_000).alias("large"))
    got = {r["column_name"]: (r["nmi"], r["suspicious"]) for r in evaluate.leakage(df, ["same", "other", "one"], "y").collect()}
    assert got["same"] == (1.0, True) and got["one"] == (0.0, False) and got["other"][0] < 0.01
    assert {c: n for c, (n, _) in got.items()} == {c: evaluate.nmi(df, c, "y").first()["nmi"] for c in ("same", "other", "one")}
    assert evaluate.suspicious(df, ["same", "other", "one"], "y") == ["same"]
    assert evaluate.suspicious(df.limit(5), ["same"], "y") == []


def test_no_placebo_of_a_single_key(spark):
    labels = spark.createDataFrame([("r", "k")], "record_id string, label string")
    assert learn.wrong_keys(labels, spark.createDataFrame([("k",)], "key string")).count() == 0
    assert learn.wrong_keys(labels, spark.createDataFrame([("k",), ("j",)], "key string")).first()["wrong_key"] == "j"
