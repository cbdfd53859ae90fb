"""The auction against all assignments of small problems."""

import itertools

import numpy as np
import pytest

from ledgermark.operators.assign import assign

EDGE = "record_id string, key string, weight double"


def greatest(weights):
    """By trying, for each record in turn, every free key or none."""
    keys = sorted({k for w in weights.values() for k in w})
    best = {frozenset(): 0}
    for w in weights.values():
        now = dict(best)
        for used, total in best.items():
            for k, x in w.items():
                if k not in used and total + x > now.get(used | {k}, -1):
                    now[used | {k}] = total + x
        best = now
    return max(best.values()), keys


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    weights = {f"r{r}": {f"k{k}": int(rng.integers(1, 12)) for k in rng.permutation(6)[: rng.integers(1, 5)]} for r in range(8)}
    rows = [(r, k, float(x)) for r, w in weights.items() for k, x in w.items()]
    rows += [(*rows[0][:2], 0.5), ("r0", "kx", None), ("r0", "ky", 0.0), (None, "k0", 99.0), ("r1", None, 99.0), ("r1", "k0", float("nan"))]
    got = assign(spark.createDataFrame(rows, EDGE).repartition(3), epsilon=1 / 9).collect()
    assert len({r["record_id"] for r in got}) == len({r["key"] for r in got}) == len(got)
    assert all(weights[r["record_id"]][r["key"]] == r["weight"] for r in got)
    assert sum(r["weight"] for r in got) == greatest(weights)[0]


def test_within_the_bound_and_the_same_again(spark):
    rng = np.random.default_rng(5)
    weights = {f"r{r}": {f"k{k}": round(float(rng.random()) * 10, 3) for k in range(5)} for r in range(9)}
    df = spark.createDataFrame([(r, k, x) for r, w in weights.items() for k, x in w.items()], EDGE)
    got = [tuple(r) for r in assign(df, epsilon=0.5).collect()]
    assert greatest(weights)[0] - 0.5 * len(got) <= sum(x[2] for x in got) <= greatest(weights)[0] + 1e-9
    assert sorted(got) == sorted(tuple(r) for r in assign(df.repartition(5), epsilon=0.5).collect())
    assert list(itertools.islice(assign(df.limit(0), 0.1).collect(), 1)) == []
    with pytest.raises(RuntimeError, match="rounds"):
        assign(df, epsilon=0.5, rounds=1)
    with pytest.raises(ValueError):
        assign(df, epsilon=0)
