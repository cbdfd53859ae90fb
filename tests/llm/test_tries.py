"""The prefix trie against brute force, and its edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgermark.llm import tries

TURNS = "conv_id long, turn long, role string, text string, node string, depth int"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(paths):
    """Nodes of ``{conv_id: [(role, text), ...]}``."""
    members, ended = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ended[tuple(path)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ended[node]))).encode()).hexdigest()) for node, m in members.items()
    )


def own(rows):
    """Turns of each conversation in order of (turn, null first; role)."""
    out = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        out[c].append((r or "", x or ""))
    return out


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.withColumn("ends_sha256", df["ends_sha256"]).collect()), key=lambda t: (t[0], t[1]))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1) for r in rows], TURNS).repartition(3)


@pytest.mark.parametrize(("shard", "bound"), [(3, 0), (30, 10**6), (4096, 10**6)])
def test_brute_force(spark, shard, bound, monkeypatch):
    monkeypatch.setattr(tries, "BROADCAST", bound)
    rng = random.Random(shard)
    rows = []
    for c in range(150):
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c - 20, None if t == 0 and c % 3 else t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["a", "bb", "cćc", None, ""])))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(80) for t in range(5)]  # a third are copies
    rows += [(2000 + c, t, "user", f"same {t}" if t < 4 else f"own {c} {t}") for c in range(40) for t in range(7)]
    got_ = got(tries.prefix_trie(tries.sequences(frame(spark, rows)), shard=shard))
    assert got_ == sorted(brute(own(rows)), key=lambda t: (t[0], t[1]))


def test_query_rebuilds(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, "user", f"{c} {t}") for c in [*range(95, 320), 5, 7, 401, 402] for t in range(rng.randint(1, 8))]
    spark.createDataFrame([(*r, "n", 1) for r in rows], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    first, paths = own(rows), {}
    for c, path in first.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = first.get(c - c % 100, [])[:h] + path[h:]
    assert any(not p for p in paths.values())
    assert got(tries.op12_prefix_trie(spark, str(tmp_path))) == sorted(brute(paths), key=lambda t: (t[0], t[1]))


def test_edges(spark):
    rows = [(None, 1, "user", "lost"), (5, 1, "user", "x" * 100_000), (5, 1, "user", "x" * 100_000), (6, None, None, None), (7, None, "", "")]
    rows += [(8, t, "user", str(t)) for t in range(300)]
    df = frame(spark, rows)
    assert got(tries.prefix_trie(tries.sequences(df), shard=20)) == sorted(brute(own([r for r in rows if r[0] is not None])), key=lambda t: (t[0], t[1]))
    assert tries.prefix_trie(tries.sequences(df.limit(0))).count() == 0


def test_double_array():
    rng = random.Random(1)
    paths = sorted({tuple(rng.randint(1, 40) for _ in range(rng.randint(0, 6))) for _ in range(800)})
    trie = tries.DoubleArray([np.array(p, np.int64) for p in paths])
    nodes = {()}
    for p in paths:
        at = 0
        for d, t in enumerate(p):
            at = int(trie.step(np.array([at]), np.array([t]))[0])
            assert at > 0
            nodes.add(p[: d + 1])
    assert int(trie.used.sum()) == len(nodes)
    for t in range(1, 60):  # what is no child isn't found
        assert (int(trie.step(np.array([0]), np.array([t]))[0]) > 0) == ((t,) in nodes)
    assert len(trie.used) < 6 * len(nodes)


def test_ends_run_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK", 50)
    members = spark.range(0, 4000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 as string)) sig", "id * 7 - 9000 conv_id").repartition(7)
    want = defaultdict(list)
    for i in range(4000):
        want["hot" if i % 3 == 0 else str(i % 50)].append(i * 7 - 9000)
    assert {r["sig"]: r["ends"] for r in tries.ends_of(members).collect()} == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
