"""Boosted ranking: gradients against plain loops, sums and splits against one machine, and what it learns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermark.operators import boost, evaluate, rank

COLUMNS = ("a", "b", "c")


def plain_gradients(score, sizes, labels, weights):
    g, h, at = [0.0] * len(score), [0.0] * len(score), 0
    for size, w in zip(sizes, weights, strict=True):
        rows = range(at, at + size)
        order = sorted(rows, key=lambda i: (-score[i], i))
        gain = {i: 1 / math.log2(k + 2) for k, i in enumerate(order)}
        right = [i for i in rows if labels[i]]
        for j in rows if right else ():
            if not labels[j]:
                p = right[0]
                chance = 1 / (1 + math.exp(score[p] - score[j]))
                swap = abs(gain[p] - gain[j]) * w
                g[j] += chance * swap
                g[p] -= chance * swap
                h[j] += chance * (1 - chance) * swap
                h[p] += chance * (1 - chance) * swap
        at += size
    return g, h


@pytest.mark.parametrize("seed", range(4))
def test_gradients(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 7, 30)
    score = np.round(rng.normal(size=sizes.sum()), 1)
    labels = np.zeros(len(score), np.int64)
    for first, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        if rng.random() < 0.9:
            labels[first + rng.integers(n)] = 1
    weights = rng.random(30)
    for got, want in zip(boost.rank_gradients(score, sizes, labels, weights), plain_gradients(score, sizes, labels, weights), strict=True):
        assert np.allclose(got, want)


def made(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(n):
        k = int(rng.integers(2, 9))
        x = rng.normal(size=(k, 3))
        best = int(np.argmax(x[:, 0] - np.abs(x[:, 1]) + (r % 2)))
        rows += [(f"r{r:04}", f"k{j}", f"k{best}", int(j == best), *map(float, x[j])) for j in range(k)]
    return spark.createDataFrame(rows, "record_id string, key string, label string, is_label int, a double, b double, c double")


def top1(forest, pairs):
    ranks = rank.with_ranks(forest.scores(pairs)).join(pairs.select("record_id", "label").distinct(), "record_id")
    return evaluate.top1_mrr(ranks).first()["top1"]


def test_learns_and_is_the_same_again(spark, monkeypatch):
    monkeypatch.setattr(boost, "ROWS", 300)
    train, test = made(spark).repartition(5), made(spark, seed=2)
    forest = boost.empty_forest(train, COLUMNS)
    blocks = boost.packed(train, forest)
    assert blocks.count() > 1
    grown = boost.grow(forest, blocks, trees=6, depth=3)
    again = boost.grow(forest, boost.packed(train.repartition(2), forest), trees=6, depth=3)
    assert grown.text() == again.text()
    assert boost.Forest.read(grown.text()).text() == grown.text()
    point = boost.grow(forest, blocks, trees=6, depth=3, objective="point")
    assert top1(grown, test) > 0.75 and top1(point, test) > 0.7
    more = boost.grow(grown, blocks, trees=6, depth=3)  # a warm start goes on where the first ended
    assert len(more.trees) == 12 and top1(more, test) >= top1(grown, test) - 0.02


def test_a_level_equals_one_machine(spark):
    train = made(spark, 60)
    forest = boost.empty_forest(train, COLUMNS)
    grown = boost.grow(forest, boost.packed(train, forest), trees=1, depth=1, least_rows=1)
    rows = train.orderBy("record_id", "key").toPandas()
    bins = forest.bins(rows[list(COLUMNS)].to_numpy(float))
    sizes = rows.groupby("record_id").size().to_numpy()
    g, h = boost.rank_gradients(np.zeros(len(rows)), sizes, rows["is_label"].to_numpy(), np.ones(len(sizes)))
    best = max(
        (sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (bins[:, f] <= b, bins[:, f] > b)), -f, -b) for f in range(3) for b in range(boost.BINS)
    )
    feature, cut, values = grown.trees[0]
    assert (feature[0], cut[0]) == (-best[1], -best[2])
    side = bins[:, feature[0]] > cut[0]
    assert np.allclose(values, [-0.3 * g[m].sum() / (h[m].sum() + 1) for m in (~side, side)], atol=1e-4)


def test_edges(spark):
    none = made(spark, 3).limit(0)
    forest = boost.grow(boost.empty_forest(none, COLUMNS), boost.packed(none, boost.empty_forest(none, COLUMNS)), trees=1, depth=2)
    odd = made(spark, 2).withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(float("nan")))
    assert {r["score"] for r in forest.scores(odd).collect()} == {0.0}
