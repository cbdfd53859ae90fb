"""Periodic runs against brute force, and their edge cases."""

import random
import zlib

import numpy as np
import pytest

from ledgermark.llm import periods

DOCS = "doc_id long, text string, runs int, collapsed string"


def brute(t, least=12):
    out = {}
    for p in range(1, len(t) // 2 + 1):
        i = 0
        while i + p < len(t):
            at = i
            while i + p < len(t) and t[i] == t[i + p]:
                i += 1
            if i > at and i - at + p >= max(least, 2 * p):
                out.setdefault((at, i - at + p), p)
            i += i == at
    return sorted((s, p, n) for (s, n), p in out.items())


def found(texts, least=12):
    got = [[] for _ in texts]
    for k, s, n, p in zip(*[x.tolist() for x in periods.runs_of([np.array(t, np.int64) for t in texts], least)], strict=True):
        got[k].append((s, p, n))
    return got


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("least", [2, 12, 30])
def test_brute_force(seed, least):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randint(1, 12)):
        k = rng.choice([1, 2, 3, 50])
        u = [rng.randrange(k) for _ in range(rng.randint(1, 40))]
        texts.append([rng.randrange(k) for _ in range(rng.randint(0, 120))] + u * rng.randint(0, 6) + [rng.randrange(k) for _ in range(rng.randint(0, 20))])
    assert found(texts, least) == [brute(t, least) for t in texts]


@pytest.mark.parametrize("make", [lambda r: [r.randrange(2) for _ in range(300)], lambda r: [0] * 200, lambda r: [0, 1, 2, 3] * 60])
def test_extensions(make):
    w = make(random.Random(3))
    lce = periods.Lce(np.array([*w, 9], np.int64))
    i, j = np.array([(i, j) for i in range(len(w)) for j in range(len(w)) if i != j]).T

    def common(i, j):
        n = 0
        while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
            n += 1
        return n

    assert lce.of(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_long_texts():
    x = np.random.default_rng(1).integers(0, 3000, 30_000)
    assert found([np.concatenate([x, x]), np.zeros(30_000, int)]) == [[(0, 30_000, 60_000)], [(0, 1, 30_000)]]


def test_copies_side_by_side():
    """Equal texts meet at a distance of their length, which is no run, as they are two texts."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3000, 400), rng.integers(0, 3000, 40)
    texts = [np.concatenate([x, y, y]), x, x, x, np.concatenate([y, y, y]), y, y, y]
    assert found(texts) == [[(400, 40, 80)], [], [], [], [(0, 40, 120)], [], [], []]


def test_documents(spark):
    unit = [f"w{i}" for i in range(7)]
    texts = [None, "", " \t\n", " ".join(unit * 3), " ".join(unit * 3), "é x " * 6, "é x " * 12, "a b " + " ".join(unit * 2) + " c", "x " * 50_000]
    docs = spark.createDataFrame([(None if i == 2 else 1000 + i, t, 1, "z") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in periods.periodic_runs(docs).collect()}
    runs = {k: [tuple(x) for x in r["runs"]] for k, r in got.items()}
    assert runs == {1000: [], 1001: [], None: [], 1003: [(0, 21, 7)], 1004: [(0, 21, 7)], 1005: [], 1006: [(0, 12, 1)], 1007: [(2, 14, 7)], 1008: [(0, 50_000, 1)]}
    assert [got[k]["collapsed"] for k in (1000, None, 1003, 1006, 1007, 1008)] == ["", "", " ".join(unit), "é x", "a b " + " ".join(unit) + " c", "x"]
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_rewriting():
    words = [b"%d" % i for i in range(100)]
    hit = next(k for k in range(100) if zlib.crc32(b"%d" % k) % 10 == 0)
    g = zlib.crc32(b"%d" % hit) // 10
    a = g % 100
    p = 1 + (100 - a) // (3 + g % 8)
    assert periods.repeated_tail(hit, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(100)]
    assert periods.repeated_tail(None, words) == words
    assert periods.repeated_tail(hit, []) == []
