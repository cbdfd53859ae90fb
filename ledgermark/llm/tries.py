"""A prefix trie of conversations, as double-array tries by prefix shard.

A conversation is the sequence of its turns, told apart by 128-bit digests of role and
text. Equal sequences become one path with a count, so copies cost nothing further. A
prefix is *shared* where more than one path and more than ``shard`` turns of paths go on
from it; shared prefixes are closed upward, so each path leaves them once, and the first
prefix behind them names its shard. Everything below that prefix lies in the one shard;
a shard holds about ``shard`` turns, or a 2^18th of all if that is more, so that shared
prefixes stay few; it holds more only if a single path is longer.

In a shard, turns get dense ids, and BASE and CHECK arrays are packed over them: the
child of node s by turn t is slot BASE[s] + t if CHECK there is s. Paths are then walked
through the arrays, all at a depth at once, which counts members; sums over subtrees go
up by CHECK. Nodes of shared prefixes give a partial row in each shard, merged globally by
one grouped sum: what depends on members adds up over paths, and what counts a node once is
given by the shard of its owner, the path with the least digest through it.

The members that end at a node are hashed as a stream: runs of ids in order are joined
by range first, so that a sequence which a third of all conversations share is a row for
every 65,536 of its characters, and no list of them is held. SHA-256 can't be split, so
the last hash of one such list runs in one task.

Cases: rows without conv_id take no part; a null turn comes first, ties go by role and
digest; null role or text is empty; repeated rows are turns of their own; an empty table
gives no nodes, and a conversation without turns ends at the root; extra columns are not
read. A conversation is one row (44 bytes a turn, without texts).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import table, written

ROOT = b"\0" * 16
#: Characters of a run of ids.
BLOCK = 65_536
#: Shared prefixes, of 60 bytes, up to which they are broadcast.
BROADCAST = 200_000
NODES = "depth long, node binary, parent binary, shared boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, weighed long, once long, ends string"


def below(node: bytes, turn: str) -> bytes:
    """A node's digest from its parent's and its last turn's."""
    return hashlib.blake2b(node + turn.encode(), digest_size=16).digest()


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """-> conv_id and own, an array of (tid, chars) in order of turns."""
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    tid = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    slim = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).isNotNull().alias("some"), F.col(turn).alias("turn"), role.alias("role"), tid.alias("tid"), F.length(text).cast("long").alias("chars")).alias("t"))
    ordered = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["tid"], t["chars"])).alias("own"))


def with_shared_heads(own: DataFrame, every: int, most: int, heads: Column) -> DataFrame:
    """Conversations whose first turns are those of the conversation at the last multiple of ``every``: -> conv_id, own."""
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_c0"), F.slice("own", 1, most).alias("_head"))
    both = own.withColumn("_h", heads).join(first, F.col("conv_id") - F.col("conv_id") % every == F.col("_c0"), "left")
    none = F.slice("own", F.lit(1), F.lit(0))
    head = F.when(F.col("_h") > 0, F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), none)).otherwise(none)
    tail = F.slice("own", F.col("_h") + 1, F.greatest(F.lit(0), F.size("own") - F.col("_h")))
    return both.select("conv_id", F.concat(head, tail).alias("own"))


def _blocks(batches):
    """Of rows in order of (sig, conv_id): comma-joined runs of ids of one sig."""
    import pyarrow as pa

    sig, first, ids, size = None, None, [], 0

    def row():
        return {"sig": sig, "first": first, "ids": ",".join(ids)}

    for batch in batches:
        out = []
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s != sig or size > BLOCK:
                if ids:
                    out.append(row())
                sig, first, ids, size = s, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("sig", pa.string()), ("first", pa.int64()), ("ids", pa.string())]))
    if ids:
        yield pa.RecordBatch.from_pylist([row()], schema=pa.schema([("sig", pa.string()), ("first", pa.int64()), ("ids", pa.string())]))


def _hashed(batches):
    """Of runs in order of (sig, first): the hash of each sig's list."""
    import pyarrow as pa

    sig, state = None, None
    for batch in batches:
        sigs, out = [], []
        for s, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if s != sig:
                if state is not None:
                    sigs.append(sig)
                    out.append(state.hexdigest())
                sig, state = s, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.string()), pa.array(out, pa.string())], names=["sig", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sig], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["sig", "ends"])


def ends_of(members: DataFrame) -> DataFrame:
    """-> sig and ends, the SHA-256 of its conv_ids in order; from ``(sig, conv_id)``."""
    runs = members.select("sig", "conv_id").repartitionByRange("sig", "conv_id").sortWithinPartitions("sig", "conv_id").mapInArrow(_blocks, "sig string, first long, ids string")
    return runs.repartition("sig").sortWithinPartitions("sig", "first").mapInArrow(_hashed, "sig string, ends string")


def _prefixes(batches):
    import pyarrow as pa

    for batch in batches:
        sig, depth, node, turns = [], [], [], []
        for s, tids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = ROOT
            nodes = [at]
            for t in tids:
                at = below(at, t)
                nodes.append(at)
            sig += [s] * len(nodes)
            depth += range(len(nodes))
            node += nodes
            turns += [len(tids)] * len(nodes)
            if len(sig) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(depth, pa.int64()), pa.array(node, pa.binary()), pa.array(turns, pa.int64())], names=["sig", "depth", "node", "turns"])
                sig, depth, node, turns = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.string()), pa.array(depth, pa.int64()), pa.array(node, pa.binary()), pa.array(turns, pa.int64())], names=["sig", "depth", "node", "turns"])


class DoubleArray:
    """BASE and CHECK over paths of dense turn ids (from 1)."""

    def __init__(self, paths: list):
        import numpy as np

        self.base, self.check = np.zeros(16, np.int64), np.full(16, -1, np.int64)
        self.used = np.zeros(16, bool)
        self.used[0] = True
        self.low = 1
        sizes = np.array([len(p) for p in paths], np.int64)
        first = np.cumsum(sizes) - sizes
        codes = np.concatenate([*paths, np.empty(0, np.int64)]).astype(np.int64)
        span = int(codes.max()) + 1 if len(codes) else 1
        at = np.zeros(len(paths), np.int64)
        for d in range(int(sizes.max()) if len(sizes) else 0):
            live = np.flatnonzero(sizes > d)
            edges, which = np.unique(at[live] * span + codes[first[live] + d], return_inverse=True)
            above, code = edges // span, edges % span
            starts = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
            slots = np.empty(len(edges), np.int64)
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(edges)], strict=True):
                slots[x:y] = self._place(int(above[x]), code[x:y])
            at[live] = slots[which]

    def _grow(self, n: int):
        import numpy as np

        if n >= len(self.used):
            more = max(n + 1 - len(self.used), len(self.used))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.used = np.concatenate([self.used, np.zeros(more, bool)])

    def _place(self, node: int, codes):
        """Finds a base with a free slot for each child; a few free slots are tried, then the end of the array."""
        import numpy as np

        while self.low < len(self.used) and self.used[self.low]:
            self.low += 1
        offsets = codes - codes[0]
        slots = None
        for f in (np.flatnonzero(~self.used[self.low : self.low + 256])[:32] + self.low).tolist():
            want = f + offsets
            if not self.used[want[want < len(self.used)]].any():
                slots = want
                break
        if slots is None:
            slots = int(np.flatnonzero(self.used)[-1]) + 1 + offsets
        self._grow(int(slots[-1]))
        self.used[slots] = True
        self.base[node] = slots[0] - codes[0]
        self.check[slots] = node
        return slots

    def step(self, nodes, codes):
        """The children of nodes by turn ids; -1 where there is none."""
        import numpy as np

        to = self.base[nodes] + codes
        inside = np.clip(to, 0, len(self.check) - 1)
        return np.where((to == inside) & (self.check[inside] == nodes), inside, -1)


def shard_nodes(pdf):
    """Nodes of the paths of a shard, those of shared prefixes as partial rows."""
    import numpy as np
    import pandas as pd

    tids = [list(t) for t in pdf["tids"]]
    kinds, dense = np.unique(np.array([t for ts in tids for t in ts], dtype=object).astype(str), return_inverse=True)
    sizes = np.array([len(t) for t in tids], np.int64)
    first = np.cumsum(sizes) - sizes
    code, chars = dense.astype(np.int64) + 1, np.concatenate([*[np.asarray(c, np.int64) for c in pdf["chars"]], np.empty(0, np.int64)])
    trie = DoubleArray([code[a : a + n] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)])
    size = len(trie.check)
    count, conv = pdf["n"].to_numpy(np.int64), pdf["conv_id"].to_numpy(np.int64)
    leaves_shared, owns = pdf["k"].to_numpy(np.int64), pdf["o"].to_numpy(np.int64)
    n, least, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, -1, np.int64)
    shared, owned, length = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.int64)
    ends = np.full(size, None, object)
    at, levels = np.zeros(len(tids), np.int64), []
    for d in range(int(sizes.max()) + 1):
        live = np.flatnonzero(sizes >= d)
        if d:
            at[live] = trie.step(at[live], code[first[live] + d - 1])
            length[at[live]] = chars[first[live] + d - 1]
        here = at[live]
        np.add.at(n, here, count[live])
        np.minimum.at(least, here, conv[live])
        depth[here] = d
        shared[here] = leaves_shared[live] > d
        owned[here[(owns[live] <= d) & (leaves_shared[live] > d)]] = True
        over = live[sizes[live] == d]
        ends[at[over]] = pdf["ends"].to_numpy(object)[over]
        levels.append(np.unique(here))
    counts_once = ~shared | owned
    weighed, once = n * length, np.where(counts_once, length, 0)
    children, leaves = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for nodes in reversed(levels):
        lone = nodes[~shared[nodes] & (children[nodes] == 0)]
        leaves[lone] = 1
        up = trie.check[nodes]
        below_root = up >= 0
        nodes, up = nodes[below_root], up[below_root]
        np.add.at(children, up, counts_once[nodes].astype(np.int64))
        for sums in (leaves, weighed, once):
            np.add.at(sums, up, sums[nodes])
    named: dict[int, bytes] = {0: ROOT}
    turn = np.zeros(size, np.int64)
    turn[levels[0]] = -1
    at = np.zeros(len(tids), np.int64)
    for d in range(1, len(levels)):
        live = np.flatnonzero(sizes >= d)
        at[live] = trie.step(at[live], code[first[live] + d - 1])
        turn[at[live]] = code[first[live] + d - 1] - 1
        for s, up, t in zip(levels[d].tolist(), trie.check[levels[d]].tolist(), turn[levels[d]].tolist(), strict=True):
            named[s] = below(named[up], str(kinds[t]))
    nodes = np.concatenate(levels)
    up = trie.check[nodes]
    above = np.maximum(up, 0)
    known = (up >= 0) & ~shared[above]
    return pd.DataFrame({
        "depth": depth[nodes], "node": [named[s] for s in nodes.tolist()], "parent": [named[s] if s >= 0 else None for s in up.tolist()], "shared": shared[nodes], "conv_id": least[nodes],
        "parent_conv_id": pd.array(np.where(known, least[above], 0), "Int64").copy() if known.all() else pd.Series(np.where(known, least[above], 0)).astype("Int64").mask(~known),
        "n_convs": n[nodes], "n_children": children[nodes], "n_leaves": leaves[nodes], "weighed": weighed[nodes], "once": once[nodes], "ends": ends[nodes],
    })


def prefix_trie(conversations: DataFrame, shard: int = 1024) -> DataFrame:
    """Nodes of the trie of ``(conv_id, own)``, as :func:`sequences` gives them.

    -> node and parent (digests), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    tids = F.transform("own", lambda t: t["tid"])
    sig = F.substring(F.sha2(F.array_join("tids", "").cast("binary"), 256), 1, 32)
    rows = written(conversations.select("conv_id", tids.alias("tids"), F.transform("own", lambda t: t["chars"]).alias("chars")).withColumn("sig", sig), "trie-rows")
    ends = ends_of(rows)
    paths = rows.groupBy("sig", "tids", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    paths = written(paths.join(ends, "sig"), "trie-paths")
    prefixes = written(paths.select("sig", "tids").mapInArrow(_prefixes, "sig string, depth long, node binary, turns long"), "trie-prefixes")
    total = prefixes.count()
    shard = max(shard, total >> 18)
    shared = prefixes.groupBy("node").agg(F.count("*").alias("paths"), F.sum("turns").alias("turns"), F.min("sig").alias("owner")).where((F.col("paths") > 1) & (F.col("turns") > shard)).select("node", "owner")
    shared = written(shared, "trie-prefixes-shared")
    # a shared prefix may have most of the paths; beyond the bound the join's larger side can be split
    shared = F.broadcast(shared) if shared.count() <= BROADCAST else shared.hint("merge")
    placed = prefixes.join(shared, "node", "left").groupBy("sig").agg(
        F.count("owner").alias("k"), F.coalesce(F.min(F.when(F.col("owner") == F.col("sig"), F.col("depth"))), F.lit(2**62)).alias("o"),
        F.coalesce(F.min_by("node", F.when(F.col("owner").isNull(), F.col("depth"))), F.max_by("node", "depth")).alias("top"),
    )
    shards = max(1, total // shard)
    dealt = paths.join(placed, "sig").withColumn("_shard", F.pmod(F.xxhash64("top"), F.lit(shards)))
    found = written(dealt.groupBy("_shard").applyInPandas(shard_nodes, NODES), "trie-nodes")
    merged = found.where("shared").groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), (F.sum("weighed") - F.sum("once")).alias("saved_tokens"), F.max("ends").alias("ends"),
    )
    merged = written(merged, "trie-shared")
    above = merged.select(F.col("node").alias("_above"), F.col("conv_id").alias("_above_conv"))
    own = found.where(~F.col("shared")).withColumn("saved_tokens", F.col("weighed") - F.col("once"))
    columns = ["node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inner, tops = own.where("parent_conv_id is not null"), own.where("parent_conv_id is null")
    border = tops.drop("parent_conv_id").select("*").unionByName(merged, allowMissingColumns=True)
    border = border.join(above, F.col("parent") == F.col("_above"), "left").withColumn("parent_conv_id", F.col("_above_conv"))
    out = inner.select(*columns).union(border.select(*columns))
    return out.withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256))).drop("ends")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(sequences(table(spark, sf_dir, "conversations")), "trie-own")
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    rebuilt = with_shared_heads(own, 100, 5, heads)
    return prefix_trie(rebuilt).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: DuckDB has no CRC-32, so it is worked out bit by bit. Ancestors are met by their lists of turns.
OP12_SQL = r"""
WITH RECURSIVE ids AS MATERIALIZED (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS t FROM conversations WHERE conv_id IS NOT NULL
), bits(conv_id, t, k, c) AS (
  SELECT conv_id, t, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, t, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, ascii(t[k // 9 + 1])::BIGINT)
    WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END
  FROM bits WHERE k < 9 * length(t)
), heads AS MATERIALIZED (
  SELECT conv_id, xor(c, 4294967295::BIGINT) % 6 AS h FROM bits WHERE k = 9 * length(t)
), kinds AS MATERIALIZED (
  SELECT row_number() OVER () AS k, role, txt, length(txt) AS chars FROM (SELECT DISTINCT coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations)
), own AS MATERIALIZED (
  SELECT conv_id, list(k ORDER BY turn NULLS FIRST) AS own FROM conversations c JOIN kinds ON kinds.role = coalesce(c.role, '') AND txt = coalesce("text", '') WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS MATERIALIZED (
  SELECT own.conv_id, CASE WHEN h > 0 THEN coalesce(f.own[1:h], []::BIGINT[]) ELSE []::BIGINT[] END || own.own[h + 1:] AS path
  FROM own JOIN heads USING (conv_id) LEFT JOIN own f ON f.conv_id = own.conv_id - own.conv_id % 100
), prefixes AS MATERIALIZED (
  SELECT conv_id, d AS "depth", path[1:d] AS pre, len(path) = d AS ended FROM rebuilt, unnest(range(len(path) + 1)) AS _(d)
), nodes AS MATERIALIZED (
  SELECT pre, "depth", min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM prefixes GROUP BY ALL
), children AS (
  SELECT pre[1:"depth" - 1] AS pre, count(*) AS n FROM nodes WHERE "depth" > 0 GROUP BY ALL
), costs AS MATERIALIZED (
  SELECT nodes.pre, "depth", coalesce((n_convs - 1) * chars, 0) AS own, (children.n IS NULL)::INT AS leaf
  FROM nodes LEFT JOIN kinds ON kinds.k = nodes.pre["depth"] LEFT JOIN children ON children.pre = nodes.pre
), sums AS (
  SELECT pre[1:d] AS pre, sum(own) AS saved, sum(leaf) AS leaves FROM costs, unnest(range("depth" + 1)) AS _(d) GROUP BY ALL
)
SELECT x.conv_id, x."depth", up.conv_id AS parent_conv_id, x.n_convs, coalesce(children.n, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums ON sums.pre = x.pre LEFT JOIN children ON children.pre = x.pre LEFT JOIN nodes up ON x."depth" > 0 AND up."depth" = x."depth" - 1 AND up.pre = x.pre[1:x."depth" - 1]
"""
