"""What one pass over the pairs leaves for later steps, so that nothing meets its keys or names again."""

from ledgermark.operators import decide, features, settle
from ledgermark.plans import queries
from tests.conftest import DATA

LEDGER = [("K1", "A", 100, 1), ("K1", "A", 140, 1), ("K1", "A", 80, 90), ("K2", "A", 500, 3), ("K3", "B", 7, 3)]


def test_nearest_amount_and_rows_of_the_best_key(spark):
    bank = spark.createDataFrame([("r1", "A", 120, 1), ("r2", "A", 499, 3), ("r3", "B", 7, None), ("r4", "C", 7, 3)], "record_id string, account string, amount_minor long, day int")
    ledger = spark.createDataFrame(LEDGER, "key string, account string, amount_minor long, day int")
    got = decide.looked_up(features.numbered(bank), ledger, features.key_stats(ledger)).select("record_id", "key", "best_amount", "best_rows").collect()
    assert sorted(map(tuple, got)) == [("r1", "K1", 100, 3), ("r2", "K2", 500, 1), ("r3", "K3", 7, 1), ("r4", None, None, None)]


def test_residuals_meet_no_key_a_second_time(spark):
    x = queries.View(spark, DATA)
    plan = queries._residuals(x)._jdf.queryExecution().optimizedPlan().toString()
    # by amount, by day, to the keys, to the records and to the bank
    assert plan.count("Join ") == 5


def test_loci_with_batches_join_nothing_by_name(spark):
    x = queries.View(spark, DATA)
    plan = queries._batched_loci(x)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 5 and "collect_list" not in plan
    rows = spark.createDataFrame([("r", "K1", "K1", True, False, "ranked", "posted", 3)], "record_id string, key string, label string, hit boolean, is_mult boolean, path string, outcome string, batch int")
    assert [tuple(r) for r in settle.loci(rows, more=("batch",)).collect()] == [("r", 3, "none")]


def test_assigned_records_travel_as_numbers_in_the_order_of_their_names(spark):
    x = queries.View(spark, DATA)
    edges = queries._numbered_edges(x)
    assert dict(edges.dtypes)["record_id"] == "bigint"
    named = [r.name for r in queries._records_by_name(x).orderBy("record_id").collect()]
    assert named == sorted(named) and len(named) > 100
    got = queries._named(x, edges.select("record_id").distinct()).select("record_id")
    assert got.exceptAll(x.bank.where("not is_mult").select("record_id")).isEmpty()
    assert got.count() > 100
