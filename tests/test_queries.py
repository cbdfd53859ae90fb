import pytest

from ledgermark.plans.queries import QUERIES, SQL
from tests.conftest import DATA, compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    compare(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_it_runs(spark, name):
    got = QUERIES[name](spark, DATA)
    assert got.columns and got.count() > 0


def test_every_record_has_one_outcome(spark):
    from ledgermark.plans.queries import View

    x = View(spark, DATA)
    d = x.decisions()
    assert d.count() == x.bank.count() == d.select("record_id").distinct().count() == 1489


def test_streamed_decisions_equal_batch(spark):
    got = QUERIES["stream_parity"](spark, DATA).collect()
    assert got and all(r["outcome"] == r["streamed"] and r["differ"] == 0 for r in got)


def test_placebo_keys_are_wrong(spark):
    assert QUERIES["placebo_keys"](spark, DATA).where("wrong_key = label").count() == 0


def test_training_pairs_keep_the_right_key(spark):
    got = QUERIES["negative_sample"](spark, DATA).groupBy("record_id").agg({"is_label": "sum", "key": "count"}).collect()
    assert all(r[1] == 1 and r[2] <= 25 or r[2] == 1 and r[1] <= 25 for r in got)


def test_group_proposals_solve_pools_up_to_the_reference_cap(spark):
    from itertools import combinations

    from pyspark.sql import functions as F

    from ledgermark.operators import solver
    from ledgermark.plans.queries import View

    x = View(spark, DATA)
    targets = x.bank.where("is_mult").select("record_id", F.col("amount_minor").alias("target"))
    pools = {r["record_id"]: r for r in solver.pools(x.cand(), x.ledger).groupBy("record_id").agg(F.collect_list(F.struct("key", "amount")).alias("pool")).join(targets, "record_id").collect()}
    got = {r["record_id"]: r for r in QUERIES["group_proposals"](spark, DATA).collect()}
    wide = sorted(i for i, r in pools.items() if 25 <= len(r["pool"]) <= 64)
    assert all(got[i]["status"] == "too_large" for i, r in pools.items() if len(r["pool"]) > 64)
    assert len(wide) > 20
    for i in wide[:: len(wide) // 20]:
        target, sums = pools[i]["target"], {}
        for k in (1, 2, 3):
            for c in combinations([p for p in pools[i]["pool"] if p["amount"] > 0], k):
                total = sum(p["amount"] for p in c)
                if abs(target - total) <= 100:
                    sums.setdefault((abs(target - total), total > target, k, total), []).append(",".join(sorted(p["key"] for p in c)))
        best = min(sums, default=None)
        want = ("infeasible", "", target) if best is None else ("solved", sums[best][0], target - best[3]) if len(sums[best]) == 1 else ("ambiguous", "", target - best[3])
        assert (got[i]["status"], got[i]["members"], got[i]["residual"]) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
