"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints at ``most`` <= 3 differing bits share at least five of their
eight bytes in place. The index lists fingerprints by the values of byte positions,
the pairs that meet in a list get their shared positional bytes tallied, those with
fewer than five are dropped, and the others are verified by their differing bits.
One position alone has 256 values, so its lists would hold N / 256 rows; instead a
list is keyed by three positions, with eight such triples chosen so that any five
positions hold one of them (checked at import). No qualifying pair is lost.

Texts with one fingerprint form one class, so copies are never paired. Lists of more
than ``block`` classes are cut into blocks that meet pairwise, and a tile of two
blocks emits a spanning forest of its links, never its pairs.

Cases: null and empty texts, and texts without words, have fingerprint zero and link
like any other; a null key is never the smallest of its component (a component of
null keys alone has a null id); repeated rows give repeated results; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import components, flat_bytes, slices, table, written

#: Any five of eight positions hold one of these.
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7))
if not all(any(set(t) <= set(five) for t in TRIPLES) for five in combinations(range(8), 5)):
    raise AssertionError("the triples miss a set of five byte positions")


def joined_words(texts):
    """Bytes of all words, A-Z lowered, one space behind each; starts of words; words before each text."""
    import numpy as np

    data, ends = flat_bytes(texts)
    n = len(ends) - 1
    raw = np.full(len(data) + n, 32, np.uint8)  # a space behind each text
    raw[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(ends))] = data
    lower = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    gap = (raw == 32) | (raw >= 9) & (raw <= 13)
    behind = np.r_[True, gap[:-1]]
    keep = ~(gap & behind)
    first = ~gap & behind
    before = np.r_[0, np.cumsum(first)]
    out = np.where(gap, np.uint8(32), lower)[keep]
    place = np.cumsum(keep) - 1
    return out, place[first], before[ends + np.arange(n + 1)]


def fingerprints(texts, words: int = 3, seed: int = 42):
    """uint64 SimHash of each text of an Arrow array."""
    import numpy as np

    from ledgermark.llm.xxh import xxh64

    data, start, upto = joined_words(texts)
    n = len(upto) - 1
    stop = np.r_[start[1:], len(data)] - 1  # without the space
    count = np.diff(upto)
    shingles = np.where(count == 0, 0, np.maximum(1, count - words + 1))
    first = np.r_[0, np.cumsum(shingles)]
    doc = np.repeat(np.arange(n), shingles)
    w = upto[doc] + np.arange(first[-1]) - first[doc]
    last = np.minimum(w + words, upto[doc + 1]) - 1
    ones = np.zeros((n, 64), np.int64)
    part = 1 << 18
    for a in range(0, int(first[-1]), part):
        b = min(a + part, int(first[-1]))
        # hash only the bytes that these shingles touch
        lo, hi = int(start[w[a]]), int(stop[last[b - 1]])
        h = xxh64(data[lo:hi], start[w[a:b]] - lo, stop[last[a:b]] - start[w[a:b]], seed)
        # runs of up to 255 shingles of one text: eight counters of 8 bits in a word
        pos = np.arange(a, b) - np.maximum(first[doc[a:b]], a)
        cut = np.flatnonzero(pos % 255 == 0)
        for byte in range(8):
            spread = _spread()[(h >> np.uint64(8 * byte)).astype(np.uint8)]
            sums = np.add.reduceat(spread, cut)
            bits = (sums[:, None] >> np.uint64(8) * np.arange(8, dtype=np.uint64) & np.uint64(255)).astype(np.int64)
            np.add.at(ones[:, 8 * byte : 8 * byte + 8], doc[a:b][cut], bits)
    return ((2 * ones > shingles[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


_table = []


def _spread():
    """Each byte value's bits as eight counters in one word."""
    import numpy as np

    if not _table:
        b = np.arange(256, dtype=np.uint64)[:, None]
        i = np.arange(8, dtype=np.uint64)
        _table.append(((b >> i & np.uint64(1)) << np.uint64(8) * i).sum(axis=1, dtype=np.uint64))
    return _table[0]


def _printed(key: str, text: str, words: int, seed: int):
    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, text):
            got = fingerprints(batch.column(batch.schema.get_field_index(text)), words, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(got)], names=[key, "fp"])

    return work


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """-> key and ``fp``, the fingerprint's 64 bits as a long."""
    return docs.select(key, text).mapInArrow(_printed(key, text, words, seed), f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def forest(a, b):
    """Of links between positions a[i] and b[i], those of a spanning forest, as positions in the arrays."""
    root: dict[int, int] = {}
    keep = []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            keep.append(i)
    return keep


def _linked(most: int):
    """Rows (list, tile, side, fp) sorted by list and tile -> links of each tile's spanning forest."""

    def links(key, side, fp):
        import numpy as np

        size = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
        first = np.r_[0, np.cumsum(size)][:-1]
        behind = np.repeat(first + size, size) - np.arange(len(key)) - 1
        out_a, out_b = [], []
        at = 0
        total = np.cumsum(behind)
        while at < len(key):  # about a million pairs at a time
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 1_000_000, "right")))
            i = np.repeat(np.arange(at, to), behind[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind[at:to]) - behind[at:to], behind[at:to])
            ok = (side[i] == 2) | (side[i] != side[j])
            i, j = i[ok], j[ok]
            x = fp[i] ^ fp[j]
            shared = sum(((x >> np.uint64(8 * k)) & np.uint64(255) == 0).astype(np.int8) for k in range(8))
            few = shared >= 5  # the count filter
            i, j, x = i[few], j[few], x[few]
            near = np.bitwise_count(x) <= most
            out_a.append(fp[i[near]])
            out_b.append(fp[j[near]])
            at = to
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        keep = forest(a, b)
        return a[keep], b[keep]

    def work(batches):
        import numpy as np

        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            same = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(same[-1]) + 1 if len(same) else 0  # the last tile may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                yield from out(cols, cut)
        if held is not None and len(held[0]):
            yield from out(held, len(held[0]))

    def out(cols, cut):
        import numpy as np
        import pyarrow as pa

        change = (cols[0][:cut][1:] != cols[0][:cut][:-1]) | (cols[1][:cut][1:] != cols[1][:cut][:-1])
        key = np.r_[0, np.cumsum(change)]
        a, b = links(key, cols[2][:cut], cols[3][:cut].view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return work


def links(classes: DataFrame, most: int = 3, block: int = 1024) -> DataFrame:
    """``classes(fp)``, distinct -> ``(a, b)``: links that join whatever ``most`` differing bits join."""

    def byte(k):
        return F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))

    keys = [F.lit(n << 24).cast("long") + byte(t[0]) * 65536 + byte(t[1]) * 256 + byte(t[2]) for n, t in enumerate(TRIPLES)]
    lists = classes.select("fp", F.explode(F.array(*keys)).alias("list"))
    sizes = written(lists.groupBy("list").count().where("count > 1").select("list", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "sim-lists")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # a block meets itself (side 2) and each other block (side 0 or 1)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = lists.join(sizes, "list").select("list", "blocks", "fp", own.alias("own"), other)
    tile = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = tiles.select("list", tile.alias("tile"), side.cast("int").alias("side"), "fp").repartition("list", "tile").sortWithinPartitions("list", "tile")
    return dealt.mapInArrow(_linked(most), "a long, b long")


def named(rows: DataFrame, edges: DataFrame, key: str, classes: DataFrame | None = None) -> DataFrame:
    """``rows(key, fp)``, written, and links of ``fp`` -> key, ``fp`` and ``component``, the smallest key that links reach."""
    if classes is None:
        classes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "sim-classes")
    found = written(components(edges, "sim-cc"), "sim-components")
    owned = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = written(owned.groupBy("root").agg(F.min("least").alias("component")), "sim-least")  # so that both sides of the join are shuffled
    name = written(owned.join(least, "root").select("fp", "component"), "sim-named")
    return rows.join(name, "fp").select(key, "fp", "component")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 3, seed: int = 42, most: int = 3, block: int = 1024) -> DataFrame:
    """-> key, ``fp`` and ``component``, the smallest key that links reach."""
    if most > 3:
        raise ValueError("the count filter guarantees five shared bytes only up to three differing bits")
    rows = written(with_fingerprints(docs, key, text, words, seed), "sim-fp")
    classes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "sim-classes")
    return named(rows, links(classes.select("fp"), most, block), key, classes)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
