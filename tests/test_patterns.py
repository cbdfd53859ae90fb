"""Frequent patterns and rules against plain counting."""

import itertools
import random
from collections import Counter

from ledgermark.operators import patterns

ROW = "a string, b int, c string, amount long"


def test_frequent_and_rules(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(6), rng.choice("pqrstuvw"), rng.randrange(100)) for _ in range(300)] + [("x", 1, "p", 5)] * 30
    n, impact = Counter(), Counter()
    for *values, amount in rows:
        items = [f"{k}={v}" for k, v in zip("abc", values, strict=True) if v is not None]
        for s in [*((i,) for i in items), *itertools.combinations(items, 2)]:
            n[s] += 1
            impact[s] += amount
    df = spark.createDataFrame(rows, ROW).repartition(3)
    got = patterns.frequent(df, ["a", "b", "c"], "amount", 12)
    want = {(" & ".join(s), len(s), k, impact[s]) for s, k in n.items() if k >= 12}
    assert {tuple(r) for r in got.collect()} == want
    rules = {(r["condition"], r["outcome"]): (r["n"], r["confidence"]) for r in patterns.proposed(got, "c").collect()}
    assert rules == {(s[0], s[1]): (k, round(k / n[s[:1]], 6)) for s, k in n.items() if k >= 12 and len(s) == 2 and s[1].startswith("c=")}
    assert patterns.frequent(df.limit(0), ["a", "b", "c"], "amount").count() == 0
