import math
import random

import pytest
from pyspark.sql import functions as F

from ledgermark.functions import dates, gate, money, residual
from ledgermark.functions.order import positioned
from ledgermark.operators import audit, blocking, evaluate, features, learn, solver
from ledgermark.sources import csv_files, settled


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "minor"), [("100", 10000), ("34,233.97", 3423397), ("0.01", 1), ("-5.50", -550), (" 1,000.5 ", 100050), ("10.005", None), ("abc", None), ("", None), ("$5", None), ("+5", None)])
def test_strict_money(spark, raw, minor):
    assert one(spark, money.strict_minor(F.lit(raw))) == minor


@pytest.mark.parametrize(("raw", "mark", "minor"), [("$1,200.50", ".", 120050), ("(5.00)", ".", -500), ("5.00-", ".", -500), ("1.234,56", ",", 123456), ("-7", ".", -700), ("$-5.00", ".", -500), ("12.345", ".", None), ("", ".", None), ("n/a", ".", None), ("5.00 EUR", ".", 500)])
def test_upload_money(spark, raw, mark, minor):
    assert one(spark, money.upload_minor(F.lit(raw), mark)) == minor


@pytest.mark.parametrize(("raw", "layout", "day"), [("1/1/00", "M/d/yy", 0), ("01/02/00", "M/d/yy", 1), ("12/31/69", "M/d/yy", -10958), ("13/45/99", "M/d/yy", None), ("1 March 2000", "d MMMM yyyy", 60), ("1 Mar 2000", "d MMM yyyy", 60), ("20000301", "yyyyMMdd", 60), ("", "yyyy-M-d", None)])
def test_dates(spark, raw, layout, day):
    assert one(spark, dates.parse_day(F.lit(raw), layout)) == day


def test_gate(spark):
    t = lambda a: one(spark, gate.threshold(F.lit(a)))
    assert t(0) == t(10_000) == 0.85 and abs(t(-100_000) - 0.87) < 1e-12 and t(10**14) == 0.995
    ask = lambda c, absent=None, p=gate.Policy(): one(spark, gate.gate(F.lit(c).cast("double"), F.lit(100), F.lit(absent), p))
    assert ask(0.85) == "post" and ask(0.8499) == "queue" and ask(None, "no_candidates") == "no_candidate" and ask(None, "grouped") == "queue"
    assert ask(0.99, p=gate.Policy(review_all=True)) == "queue"
    with pytest.raises(Exception, match="confidence"):
        ask(1.5)


def test_residual_causes(spark):
    got = one(spark, residual.causes(F.lit(-250), F.lit(100_000), F.lit(1), 25))
    assert got[0]["cause"] == "BANK_CHARGE" and got[0]["fit"] == 1.0 and [c["fit"] for c in got] == sorted((c["fit"] for c in got), reverse=True)
    assert one(spark, residual.causes(F.lit(0), F.lit(1), F.lit(1), 25)) == []
    text = one(spark, residual.sentence(F.lit("FX_DIFFERENCE"), F.lit(-250), F.lit(123_456_700), F.lit(2)))
    assert text == "Gap of -2.50 against 1,234,567.00 is consistent with a rate difference."
    ok = lambda t: one(spark, residual.figures_allowed(F.lit(t), F.array(F.lit(-2.5).cast("decimal(38,6)"))))
    assert ok("gap 2.50") and not ok("gap 2.50 and 3")


def test_positions(spark):
    random.seed(1)
    values = [random.randint(0, 50) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(7)
    got = {r["id"]: (r["position"], r["s"]) for r in positioned(df, [F.col("v").desc(), "id"], {"s": F.col("v")}).collect()}
    total = 0
    for p, (i, v) in enumerate(sorted(enumerate(values), key=lambda x: (-x[1], x[0])), 1):
        total += v
        assert got[i] == (p, total)


def test_solver_joins_equal_trying_all(spark):
    random.seed(2)
    pools, targets, want = [], [], {}
    for r in range(150):
        amounts = [random.randint(0, 12) for _ in range(random.randint(0, 7))]
        target = random.randint(0, 25)
        targets.append((f"r{r}", target))
        pools += [(f"r{r}", f"k{i}", a) for i, a in enumerate(amounts)]
        want[f"r{r}"] = solver.brute(target, amounts)
        assert solver.solve_one(target, amounts)[0] == want[f"r{r}"]
    got = solver.solve(spark.createDataFrame(targets, "record_id string, target long"), spark.createDataFrame(pools, "record_id string, key string, amount long")).collect()
    assert {r["record_id"]: r["status"] for r in got} == want


def test_solver_tolerance_and_bounds():
    assert solver.solve_one(100, [60, 39, 90], tolerance=2) == ("solved", [0, 1], 1)
    assert solver.solve_one(5, [5, 5])[0] == "ambiguous" and solver.solve_one(5, [5, 5], unique=False)[0] == "solved"
    assert solver.solve_one(5, [1] * 65)[0] == "too_large" and solver.solve_one(10, [1, 2, 3, 4], most=4) == ("solved", [0, 1, 2, 3], 0)
    with pytest.raises(ValueError, match="negative"):
        solver.solve_one(-1, [])


def test_blocking_edges(spark):
    bank = spark.createDataFrame([("a", "X", 5, 10), ("b", None, 5, 10), ("c", "X", 7, None)], "record_id string, account string, amount_minor long, day int")
    ledger = spark.createDataFrame([("k1", "X", 5, 99), ("k2", "X", 1, 17), ("k3", "X", 1, 18), ("k4", None, 5, 10), ("k5", "X", 7, None), ("k6", "X", 1, 3), ("k7", "X", 1, 2)], "key string, account string, amount_minor long, day int")
    got = sorted(map(tuple, blocking.candidates(bank, ledger).collect()))
    assert got == [("a", "k1"), ("a", "k2"), ("a", "k6"), ("c", "k5")]
    with pytest.raises(ValueError, match="slack"):
        blocking.candidates(bank, ledger, -1)


def test_features_count_equal_amounts_once_and_prefer_the_earlier_day(spark):
    ledger = spark.createDataFrame([("k", "X", 500, 98), ("k", "X", 500, 102), ("k", "Y", 100, 98)], "key string, account string, amount_minor long, day int")
    bank = spark.createDataFrame([("a", "X", 400, 100, "k", False)], "record_id string, account string, amount_minor long, day int, label string, is_mult boolean")
    r = features.pairs(blocking.candidates(bank, ledger), bank, features.key_stats(ledger)).first()
    assert r["key_total_major"] == 6.0 and r["date_gap_signed"] == 2.0 and r["key_n_rows"] == 3.0 and r["amount_delta_abs"] == 1.0


@pytest.mark.parametrize(
    ("candidates", "ranked", "posted", "routed", "truly", "want"),
    [(["k"], ["k"], False, True, True, "none"), (["k"], ["k"], False, True, False, "multiplicity"), (["j"], ["j"], True, False, False, "blocking"), ([], [], False, False, False, "blocking"), (["k", "j"], ["j", "k"], True, False, False, "ranking"), (["k"], ["k"], False, False, False, "threshold"), (None, [], False, False, False, "unattributed"), (["k"], ["k"], True, False, False, "none")],
)
def test_locus(spark, candidates, ranked, posted, routed, truly, want):
    df = spark.createDataFrame([(["k"], candidates, ranked, posted, routed, truly)], "c array<string>, s array<string>, r array<string>, p boolean, m boolean, t boolean")
    assert df.select(learn.locus(*[F.col(c) for c in "csrpmt"]).alias("x")).first()["x"] == want


def test_cases(spark):
    df = spark.createDataFrame([(1, "a", "l", [1.0, 0.0]), (2, "b", "l", [0.99, 0.01]), (3, "c", "l", [0.0, 1.0]), (4, "d", "m", [1.0, 0.0])], "seq long, case_id string, locus string, situation array<double>")
    assert sorted(map(tuple, learn.retain(df).collect())) == [("l", "a", 1), ("l", "c", 0), ("m", "d", 0)]
    cases = df.select("case_id", "locus", "situation", F.lit(False).alias("retired"))
    got = learn.retrieve(spark.createDataFrame([("q", "l", [1.0, 0.0])], "query_id string, locus string, situation array<double>"), cases).collect()
    assert [(r["case_id"], r["rank"]) for r in got] == [("a", 1), ("b", 2)]


def test_measures(spark):
    random.seed(3)
    data = [(i, round(random.random(), 1), int(random.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, score double, truth int")
    pos, neg = [s for _, s, t in data if t], [s for _, s, t in data if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(evaluate.roc_auc(df).first()["roc_auc"] - auc) < 1e-6
    assert math.isclose(sum(r["n"] for r in evaluate.reliability(df).collect()), 200)
    assert evaluate.suspicious(df.withColumn("leak", F.col("truth") * 2), ["leak", "score"], "truth") == ["leak"]
    with pytest.raises(ValueError, match="outcome"):
        evaluate.assert_no_outcome_columns(df.withColumn("MatchRule", F.lit(1)))


def test_trail(spark, tmp_path):
    t = audit.Trail(spark, str(tmp_path / "trail"))
    with pytest.raises(ValueError, match="approver"):
        t.start_run("")
    run = t.start_run("someone", blocking={"days": 7}, gate={"base": 0.85}, notes="first")
    assert t.runs().select("blocking", "notes", "finished_at").first() == ('{"days": 7}', "first", None)
    d = spark.createDataFrame([("r1", "queued", "ranked", "k", 0.5, 0.85, 100, ["k", "j"], 0.1, 2, 2), ("r2", "posted", "direct", "k", 0.99, 0.85, 100, ["k"], None, 1, 1)], "record_id string, outcome string, path string, key string, confidence double, threshold double, amount_minor long, ranked_keys array<string>, margin double, n_blocked long, n_scored long")
    t.record(run, d)
    t.record_corrections(run, spark.createDataFrame([("r1", ["j"], "ranking")], "record_id string, correct_keys array<string>, locus string"), reviewer="me")
    assert t.decisions(run).count() == 3 and {r["record_id"]: r["outcome"] for r in t.latest(run).collect()} == {"r1": "correction", "r2": "posted"}
    assert [(r["seq"], r["record_id"], r["n_candidates"], r["policy_version"], list(r["keys"])) for r in t.decisions(run).collect()] == [(1, "r1", 2, "1", ["k"]), (2, "r2", 1, "1", ["k"]), (3, "r1", 2, "1", ["j"])]
    assert all(r["decided_at"] for r in t.decisions(run).collect()) and t.decisions(run).where("reviewer = 'me'").count() == 1
    assert t.latest(run, machine_only=True).where("record_id = 'r1'").first()["outcome"] == "queued"
    t.finish_run(run)
    assert t.status(run) == "completed"
    with pytest.raises(ValueError, match="not running"):
        t.fail_run(run, "late")
    assert not any(hasattr(t, x) for x in ("delete", "update", "overwrite"))


def test_uploads(spark, tmp_path):
    p = tmp_path / "bank.csv"
    p.write_text("﻿Val Dt;Txn Amt (EUR);A/c No\n01/03/2026;1.234,56;ACC1\n;;\n02/03/2026;10,005;ACC1\n25/03/2026;(7,00);\n;1,00;A\n31/31/2026;1,00;A\n")
    good, bad, layout = csv_files.read_bank(spark, str(p))
    assert layout == "d/M/yyyy" and sorted(r["amount_minor"] for r in good.collect()) == [-700, 123456] and [tuple(r) for r in bad.orderBy("_row").collect()] == [(3, "row-3", "unreadable amount"), (5, "row-5", "blank date"), (6, "row-6", "unreadable date")]
    assert sorted((r["record_id"], r["account"]) for r in good.collect()) == [("row-2", "ACC1"), ("row-4", None)]
    q = tmp_path / "ledger.csv"
    q.write_text("key,account,amount,date\nINV-1,ACC1,12.00,2026-03-01\n,ACC1,3,2026-03-02\n")
    keys = [r["key"] for r in csv_files.read_ledger(spark, str(q))[0].collect()]
    assert sorted(keys) == ["INV-1", "row-3"]
    q.write_text('id,account,amount,date\nb1,"A\nB ""x""",1.00,2026-03-01\nb2,A,2,2026-03-02\n')
    assert sorted((r["record_id"], r["account"]) for r in csv_files.read_bank(spark, str(q))[0].collect()) == [("b1", 'A\nB "x"'), ("b2", "A")]
    for text, said in (("id,account,amount\nb1,A,1.00\n", "no column for date"), ("id,account,amount,date\n", "no rows"), ("", "no header")):
        q.write_text(text)
        with pytest.raises(ValueError, match=said):
            csv_files.read_bank(spark, str(q))
    assert csv_files.columns(["Debit", "Booking day", "IBAN", "Allocation"]) == {"amount": "Debit", "date": "Booking day", "account": "IBAN", "key": "Allocation"}
    assert csv_files.columns(["x", "y"], lambda h: {"amount": "x", "date": "nope"}) == {"amount": "x"}


def test_wide_frame(spark):
    cols = ["matchId", "A_amount", "A_valueDate", "A_account", "generatorAllocation", "B_amount", "B_valueDate", "B_account", "targetAllocation"]
    df = spark.createDataFrame([("m1", "5", "1/2/00", "X", "K1", "5", "1/3/00", None, "K1"), ("m2", None, None, None, None, "7", "", "Y", ""), ("m3", "x", "1/2/00", "X", "K2", None, None, None, None), ("m4", "1", "13/45/99", "X", "K2", None, None, None, None)], ", ".join(f"{c} string" for c in cols))
    ledger, bank, bad = csv_files.wide_frame(df)
    assert [tuple(r) for r in ledger.collect()] == [("K1", "X", 500, 1)]
    assert sorted((r["account"], r["amount_minor"], r["day"], r["label"], r["is_mult"]) for r in bank.collect()) == [("X", 500, 2, "K1", False), ("Y", 700, None, "MULT", True)]
    assert bad.count() == 2
    with pytest.raises(Exception, match="unreadable"):
        csv_files.wide_frame(df, strict=True)[0].collect()


def test_settled_lines(spark):
    items = {"items": [{"entity_id": "p1", "settlement_id": "s1", "credit": 100, "fee": None, "settled_at": 5}, {"entity_id": "p2", "settlement_id": None}]}
    ask = dict(year=2024, month=1, fetch=lambda url, auth: items, base="https://x.invalid/recon")
    got = settled.fetch_settled(spark, "rzp_test_x", "y", **ask).collect()
    assert len(got) == 1 and got[0]["credit"] == 100 and got[0]["fee"] == 0
    for bad in ({"key_id": "live"}, {"month": 13}, {"count": 2000}):
        with pytest.raises(ValueError):
            settled.fetch_settled(spark, **({"key_id": "rzp_test_x", "key_secret": "y", **ask} | bad))


@pytest.mark.parametrize(("tolerance", "most", "unique"), [(0, 3, True), (3, 3, True), (3, 2, False), (5, 3, False)])
def test_many_pools_at_once_equal_one_by_one(tolerance, most, unique):
    rng = random.Random(tolerance + most)
    cases = [(rng.randint(0, 60), [rng.randint(0, 40) for _ in range(rng.randint(0, 9))]) for _ in range(400)] + [(30, [1] * 65), (6_000_000_000, [5])]
    options = {"tolerance": tolerance, "most": most, "unique": unique}
    assert solver.solve_many(*map(list, zip(*cases, strict=True)), **options) == [solver.solve_one(t, a, **options) for t, a in cases]


def test_solve_takes_pools_by_key(spark):
    """A key's amounts as an array count one by one towards the pool, missing ones too; the same answers as from rows."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(r, f"K{k}", rng.choice([None, -5, *range(1, 12)])) for r in range(60) for k in range(rng.randint(1, 6)) for _ in range(rng.randint(1, 3))]
    pool = spark.createDataFrame(sorted(set(rows), key=repr), "record_id long, key string, amount long")
    targets = spark.createDataFrame([(r, rng.randint(0, 40)) for r in range(62)] + [(62, -1)], "record_id long, target long")
    by_key = pool.groupBy("record_id", "key").agg(F.collect_set(F.struct("amount")).alias("amounts"))
    want = sorted(map(tuple, solver.solve(targets, pool, cap=10).collect()))
    assert sorted(map(tuple, solver.solve(targets, by_key, cap=10).collect())) == want
    assert {r[3] for r in want} == {"invalid", "solved", "too_large", "infeasible", "ambiguous"}
    pools = {}
    for r in pool.collect():
        pools.setdefault(r[0], []).append(r[2])
    for record, target, n, status, *_ in want:
        amounts = pools.get(record, [])
        assert n == len(amounts)
        if target > 0 and n <= 10:
            assert status == solver.brute(target, [a for a in amounts if a is not None and a > 0])
