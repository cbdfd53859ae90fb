"""Splits by first day without putting all groups in order, and what the detector and calibration take of them."""

import random

import pytest
from pyspark.sql import functions as F

from ledgermark.operators import evaluate, features
from ledgermark.plans import queries
from tests.conftest import DATA


def _rows(spark, n, days, seed=5):
    r = random.Random(seed)
    rows = [(i, None if r.random() < 0.05 else f"m{r.randrange(n // 2)}", None if r.random() < 0.1 else r.randrange(days)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i int, match_id string, day int")


@pytest.mark.parametrize(("n", "days", "train", "val"), [(400, 3, 0.7, 0.1), (400, 90, 0.7, 0.1), (60, 1, 0.5, 0.0), (3, 2, 0.1, 0.1), (40, 5, 0.01, 0.98)])
def test_splits_are_those_of_all_groups_in_order(spark, n, days, train, val):
    rows, df = _rows(spark, n, days)
    first = {}
    for _, g, d in rows:
        first[g] = min((x for x in (first.get(g), d) if x is not None), default=None)
    dated = sorted((d, g is not None, g or "", g) for g, d in first.items() if d is not None)
    want = {g: "train" for g in first} | {g: "train" if k < int(len(dated) * train) else "val" if k < int(len(dated) * (train + val)) else "test" for k, (*_, g) in enumerate(dated)}
    assert {(r.grp, r.first_day, r.split) for r in evaluate.temporal_split(df, train=train, val=val).collect()} == {(g, first[g], s) for g, s in want.items()}
    got = evaluate.with_split(df, train=train, val=val)
    assert {tuple(r) for r in got.collect()} == {(i, g, d, want[g]) for i, g, d in rows if g is not None}


@pytest.mark.parametrize("values", [[3], [1, 2], [5, 5, 5, 9], [0, 10**12, 3, 7, 10**9], [-4, None, 8, -4, 2], list(range(0, 99_999, 7)), [None], []])
def test_median_from_counts(spark, values):
    df = spark.createDataFrame([(x,) for x in values], "a long")
    assert features.median(df) == df.agg(F.percentile("a", 0.5)).first()[0]


def test_the_ledger_is_dealt_out_as_rows(spark):
    x = queries.View(spark, DATA)
    for df in (x.stats(), queries.fx.groups(x.ledger)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.rindex("Aggregate") < plan.index("Exchange")


def test_the_detector_groups_the_bank_once(spark, monkeypatch):
    made = []
    for name in ("found", "candidates"):
        monkeypatch.setattr(queries.blocking, name, lambda bank, *a, real=getattr(queries.blocking, name): made.append(bank) or real(bank, *a))
    assert queries.QUERIES["gbt_multiplicity"](spark, DATA).count() == 1
    # the only bank that is matched is a written table, not one made from the ledger again
    assert len(made) == 1 and "parquet" in made[0]._jdf.queryExecution().executedPlan().toString() and "Exchange" not in made[0]._jdf.queryExecution().executedPlan().toString()


def test_calibration_matches_no_training_records(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries.decide, "looked_up", lambda records, *a, real=queries.decide.looked_up: asked.append(records) or real(records, *a))
    assert queries.QUERIES["isotonic_gate"](spark, DATA).count() == 3
    assert {r.split for r in asked[0].select("split").distinct().collect()} == {"val", "test"}
