"""Ranges, identity, clusters and history against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgermark.operators import clusters, history, identity, ranges


def test_references_and_ranges(spark):
    texts = ["INV1234-6", "x INV1298-302, INV7.", "INV15-2", "INV100-200", "INV9-11", None, "", "INV1234567890123456", "PREINV5", "INV5-6A"]
    got = [[tuple(x) for x in r["r"]] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ranges.references(F.col("t")).alias("r")).collect()]
    assert got == [[(1234, 1236)], [(1298, 1302), (7, 7)], [(15, 15)], [(100, 200)], [(9, 11)], [], [], [], [], [(5, 5)]]


def test_in_ranges_equals_brute_force(spark):
    random.seed(4)
    spans = [(a, a + random.choice([0, 1, 2, 7, 63, 100, 5000])) for a in (random.randrange(3000) for _ in range(60))] + [(0, 0), (0, 4095), (5, 4), (-3, 9), (None, 3), (10**14, 10**14 + 10**12)]
    points = [random.randrange(4000) for _ in range(80)] + [0, 4095, -1, None, 10**14 + 777, 7, 7]
    df = spark.createDataFrame([(i, i % 2, *s) for i, s in enumerate(spans)], "id int, acc int, lo long, hi long")
    at = spark.createDataFrame([(p, j % 2, j) for j, p in enumerate(points)], "p long, acc int, j int")
    fits = lambda s, p: None not in (*s, p) and p >= 0 and s[0] >= 0 and s[0] <= p <= s[1]
    want = sorted((i, j) for i, s in enumerate(spans) for j, p in enumerate(points) if fits(s, p))
    assert sorted((r["id"], r["j"]) for r in ranges.in_ranges(df, at.drop("acc"), "p").collect()) == want and len(want) > 500
    assert sorted((r["id"], r["j"]) for r in ranges.in_ranges(df, at, "p", ["acc"]).collect()) == [(i, j) for i, j in want if i % 2 == j % 2]
    cut = df.select(F.size(ranges.blocks(F.col("lo"), F.col("hi"))).alias("n")).agg(F.max("n")).first()[0]
    assert cut <= 80  # 10^12 numbers
    assert ranges.in_ranges(df.limit(0), at.drop("acc"), "p").count() == 0


def grams(x):
    x = f" {x} "
    return {x[i : i + 3] for i in range(len(x) - 2)}


def test_similar_equals_brute_force(spark):
    random.seed(8)
    known = ["".join(random.choice("abcd ") for _ in range(random.randint(1, 14))).strip() or "a" for _ in range(150)] + ["é", "zomato"]
    asked = [k[:i] + random.choice("abcd") + k[i:] for k in known for i in [random.randrange(len(k) + 1)]] + ["", "zomatoo"]
    want = {(a, b) for a in set(asked) - {""} for b in set(known) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.6}
    frame = lambda x: spark.createDataFrame([(v,) for v in sorted(set(x))], "name string")
    got = {(r["left"], r["right"]) for r in identity.similar(frame(asked), frame(known), 0.6).collect()}
    assert got == want and len(want) > 50


def test_similar_writes_names_once_and_no_signs(spark, monkeypatch):
    """Names travel as numbers, a row for each pair of groups is never written, and names without a possible partner are left out."""
    random.seed(3)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    known = sorted({f"{word(7)} {word(8)} {word(5)}" for _ in range(150)})
    asked = sorted({k[:4] + k[5:] for k in known} | {k[:3] + "x" + k[3:] for k in known} | {word(32) for _ in range(150)} | {f"t {word(11)} house" for _ in range(150)} | {" ".join(word(2) for _ in range(9))})
    rows, real = [], identity.checkpointed

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(identity, "checkpointed", counted)
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "name string")
    found = identity.similar(frame(asked), frame(known), 0.6)
    got = {(r["left"], r["right"]): r["similarity"] for r in found.collect()}
    want = {(a, b): len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in asked for b in known if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.6}
    assert got == want and len(want) >= 200
    groups = {g for x in known for g in grams(x)} & {g for x in asked for g in grams(x)}
    assert sum(rows) <= len(asked) + len(known) + len(groups) + 2000  # shapes
    join = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "[sign" in line and "Join" in line)
    assert "SortMergeJoin" in join


def test_resolve_by_layers(spark):
    entities = spark.createDataFrame([(1, "Zomato Media Pvt. Ltd.", "G1"), (2, "Reliance Industries Limited", None), (3, "Reliance Retail Ltd", None), (4, "Twin Corp", None), (5, "TWIN", ""), (6, "Eternal", "G6")], "entity_id long, canonical_name string, identifier string")
    aliases = spark.createDataFrame([("Swift Foods", 6, "human", 0, 0), ("Quick Foods", 6, "llm", 9, 0), ("Blue Dot", 2, "cooccurrence", 3, 0), ("Red Dot", 2, "cooccurrence", 3, 1), ("Grey Dot", 2, "cooccurrence", 2, 0)], "alias string, entity_id long, evidence string, confirmations int, contradictions int")
    asked = [("anything", "G6"), ("zomato media", None), ("Z.o.m.a.t.o. MEDIA llp", "G9"), ("Reliance Industris", None), ("twin", None), ("Swift Foods Inc", ""), ("Quick Foods", None), ("blue dot", None), ("Red Dot", None), ("Grey Dot", None), (None, None), ("Ltd", None), ("zomato media", None)]
    got = {(r["name"], r["identifier"]): (r["entity_id"], r["layer"]) for r in identity.resolve(spark.createDataFrame(asked, "name string, identifier string"), entities, aliases).collect()}
    assert got == {
        ("anything", "G6"): (6, "identifier"), ("zomato media", None): (1, "exact"), ("Z.o.m.a.t.o. MEDIA llp", "G9"): (1, "exact"), ("Reliance Industris", None): (2, "fuzzy"), ("twin", None): (None, "ambiguous"),
        ("Swift Foods Inc", None): (6, "alias"), ("Quick Foods", None): (None, "none"), ("blue dot", None): (2, "alias"), ("Red Dot", None): (None, "none"), ("Grey Dot", None): (None, "none"), (None, None): (None, "none"), ("Ltd", None): (None, "none"),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    random.seed(seed)
    edges = [(f"n{random.randrange(90):03d}", f"n{random.randrange(90):03d}") for _ in range(70)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert {r["name"]: r["component"] for r in clusters.components(spark.createDataFrame(edges, "a string, b string")).collect()} == want


def test_guards(spark):
    names = [("a", None), ("b", "G1"), ("c", None), ("d", "G2"), ("e", "G2"), ("w", None), ("x", ""), ("lone", "G9")] + [(f"o{i}", None) for i in range(5)]
    edges = [
        ("b", "a", 0.9, "cooccurrence"), ("b", "c", 0.95, "cooccurrence"), ("c", "d", 0.91, "cooccurrence"), ("d", "e", None, "gstin"), ("w", "x", 0.5, "fuzzy"), ("w", "w", 1.0, "human"), (None, "w", 1.0, "human"), ("w", "nobody", 1.0, "human"),
        ("c", "b", 0.2, "cooccurrence"), ("w", "x", float("nan"), None),
    ] + [(f"o{i}", f"o{i + 1}", 0.99, "cooccurrence") for i in range(4)]
    out, why = clusters.clustered(spark.createDataFrame(names, "name string, identifier string"), spark.createDataFrame(edges, "a string, b string, weight double, evidence string"), most=4 + 1)
    assert {r["name"]: (r["cluster"], r["state"]) for r in out.collect() if not r["name"].startswith("o")} == {"a": ("a", "clustered"), "b": ("a", "clustered"), "c": ("a", "clustered"), "d": ("d", "clustered"), "e": ("d", "clustered"), "w": ("w", "single"), "x": ("x", "single"), "lone": ("lone", "single")}
    assert {(r["a"], r["b"]): (r["status"], r["cluster"]) for r in why.collect() if r["a"] < "o"} == {("a", "b"): ("merged", "a"), ("b", "c"): ("merged", "a"), ("c", "d"): ("flagged", None), ("d", "e"): ("merged", "d")}
    out, why = clusters.clustered(spark.createDataFrame(names, "name string, identifier string"), spark.createDataFrame(edges, "a string, b string, weight double, evidence string"), most=4)
    assert {(r["name"], r["cluster"], r["state"]) for r in out.collect() if r["name"] in "abcdeo1"} == {(n, n, "oversized") for n in ("a", "b", "c", "d", "e", "o1")}
    assert why.where("status = 'oversized'").count() == 8 and why.where("status = 'weak'").count() == 2


def test_history_merges_within_its_bound(spark):
    random.seed(6)
    rows = [("p", d, int(random.expovariate(0.02)), random.randrange(10**6), random.choice([0, 50, 100]), random.random() < 0.3) for d in range(20) for _ in range(500)] + [("q", 1, 5, 100, 200, False), ("q", 2, None, None, None, True), (None, 1, 1, 1, 0, False)]
    records = spark.createDataFrame(rows, "payer string, day int, lag_days int, amount_minor long, deduction_bps int, is_mult boolean")
    parts = history.daily(records)
    got = {r["payer"]: r for r in history.history(history.rolled(history.rolled(parts.withColumn("week", F.expr("day div 7")), ["payer", "week"]), ["payer"])).collect()}
    lags = sorted(r[2] for r in rows if r[0] == "p")
    for q, c in ((0.5, "median_lag_days"), (0.9, "p90_lag_days")):
        assert lags[int((q - 0.0133) * len(lags))] <= got["p"][c] <= lags[int((q + 0.0133) * len(lags))]
    assert (got["q"]["n_records"], got["q"]["median_lag_days"], got["q"]["usual_deduction_bps"], got["q"]["deduction_stability"], got["q"]["mult_rate"]) == (2, 5, 200, 1.0, 0.5)
    assert got[None]["deduction_stability"] is None
    assert history.history(history.rolled(history.daily(records.limit(0)), ["payer"])).count() == 0


@pytest.mark.parametrize("least", [0.2, 0.6, 1.0])
def test_similar_names_that_share_one_group_or_two(spark, least):
    """Names of one to four letters, where prefixes for two shared groups are whole names or don't do."""
    names = sorted({"".join(p) for n in (1, 2, 3, 4) for p in itertools.product("ab", repeat=n)})
    sets = {x: {f" {x} "[i : i + 3] for i in range(len(x))} for x in names}
    df = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r["left"], r["right"]) for r in identity.similar(df, df, least).collect()}
    assert got == {(x, y) for x in names for y in names if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= least}
