"""Near copies by Jaccard similarity of word shingles; a prefix-filter join, so no pair is lost.

A text's shingles (``words`` words; all of them where it has fewer) are hashed, and the
distinct hashes put into one order for all texts: rare ones first, then by value. Of two
sets whose similarity is ``least`` or more, the first n - ceil(least * n) + 1 hashes of each
share one at least (Chaudhuri, Ganti and Kaushik, 2006), so texts are listed by these. Any
order is exact; rare ones first keeps passages that many texts share out of the lists. What
is frequent is read from counts in :data:`SKETCH` cells, summed over all texts, of which a
partition names those well above its mean; so what the driver gets has a fixed bound.

Counts of the hashes in buckets, about one for eight hashes, bound the sets' difference from
below; the pairs in a list that these allow make rough components, within which pairs are
verified over whole sets. Only texts in rough components have their sets made again and sent,
once each. SimHash has no such bound: at similarity 0.8 about ten of 64 bits differ, in some
pairs many more.

Texts with one set form one class, so copies are never paired. Lists of more than
``block`` classes are cut into blocks that meet pairwise, and a tile of two blocks emits a
spanning forest of its links, never its pairs; the same holds for rough components.

Cases: as in :mod:`ledgermark.llm.simhash`; texts without words have the empty set, and
are copies of each other.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.llm.common import components, slices, written
from ledgermark.llm.simhash import joined_words, named

#: Least similarity of near copies.
LEAST = Fraction(4, 5)
#: Fewest and most buckets of a set's counts; powers of two, so that more fold into fewer.
BUCKETS = (64, 4096)
#: Cells of the table of frequent hashes.
SKETCH = 1 << 18


def shingle_hashes(texts, words: int = 5, seed: int = 42):
    """uint64 hashes of each text's shingles, repeats included, and the text of each."""
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
    h = np.empty(int(first[-1]), np.uint64)
    part = 1 << 18
    for a in range(0, len(h), part):
        b = min(a + part, len(h))
        lo, hi = int(start[w[a]]), int(stop[last[b - 1]])
        h[a:b] = xxh64(data[lo:hi], start[w[a:b]] - lo, stop[last[a:b]] - start[w[a:b]], seed)
    return h, doc


def shingle_sets(texts, words: int = 5, seed: int = 42):
    """Sorted distinct uint64 hashes of each text's shingles, flat, and n+1 offsets."""
    import numpy as np

    h, doc = shingle_hashes(texts, words, seed)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
    return h[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(texts)))]


def names_of(flat, ends):
    """A 64-bit name of each set."""
    import hashlib

    raw = flat.tobytes()
    return [int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def buckets_of(n):
    """The number of buckets of sets of n hashes: a power of two near n / 8, within :data:`BUCKETS`."""
    import numpy as np

    return (1 << np.ceil(np.log2(np.clip(n / 8, *BUCKETS))).astype(np.int64)).astype(np.int64)


def _frequent(text: str, words: int, seed: int):
    """Cells of the sketch that a partition fills well above its mean, with their counts."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        cells = np.zeros(SKETCH, np.int64)
        for batch in slices(batches, text):
            h, _ = shingle_hashes(batch.column(batch.schema.get_field_index(text)), words, seed)
            cells += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        many = np.flatnonzero(cells > 2 * cells.mean() + 4)
        yield pa.RecordBatch.from_arrays([pa.array(many.astype(np.int32)), pa.array(cells[many])], names=["cell", "n"])

    return work


def frequent(docs: DataFrame, text: str, words: int, seed: int):
    """An array of :data:`SKETCH` counts, 0 where nothing stands out; it only orders hashes."""
    import numpy as np

    got = docs.select(text).mapInArrow(_frequent(text, words, seed), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(SKETCH, np.int64)
    cells[got["cell"].to_numpy()] = got["n"].to_numpy()
    return cells


def _prefixes(columns: list[str], text: str, words: int, seed: int, least: Fraction, cells):
    """-> columns, fp, n, counts and the hashes by which a text is listed."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        weight = cells.value
        for batch in slices(batches, text):
            flat, ends = shingle_sets(batch.column(batch.schema.get_field_index(text)), words, seed)
            n = np.diff(ends)
            doc = np.repeat(np.arange(len(n)), n)
            b = buckets_of(n)
            at = np.r_[0, np.cumsum(b)]
            counts = np.bincount(at[doc] + (flat % b[doc].astype(np.uint64)).astype(np.int64), minlength=int(at[-1]))
            raw = np.minimum(counts, 255).astype(np.uint8).tobytes()  # a cut at 255 only lowers differences
            counts = [raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            listed = np.where(n > 0, n + (-n * least.numerator) // least.denominator + 1, 0)
            order = np.lexsort((flat, weight[(flat % np.uint64(SKETCH)).astype(np.int64)], doc))
            taken = order[np.arange(len(flat)) - ends[doc] < listed[doc]]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(listed)].astype(np.int32)), pa.array(flat[taken].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in columns] + [pa.array(names_of(flat, ends), pa.int64()), pa.array(n.astype(np.int32)), pa.array(counts, pa.binary()), lists],
                names=[*columns, "fp", "n", "counts", "lists"],
            )

    return work


def _sets(text: str, words: int, seed: int):
    """-> fp, n and all hashes."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, text):
            flat, ends = shingle_sets(batch.column(batch.schema.get_field_index(text)), words, seed)
            hashes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names_of(flat, ends), pa.int64()), pa.array(np.diff(ends).astype(np.int32)), hashes], names=["fp", "n", "hashes"])

    return work


def by_counts(rows, least: Fraction):
    """Rows (..., n, counts) -> a function of a tile's bounds, which gives a function of i: the later sets that counts allow to be near.

    Sets that are near have numbers of buckets that differ by a factor of two at most;
    the larger is folded.
    """
    import numpy as np

    n = rows.column(4).to_numpy().astype(np.int64)
    raw = rows.column(5).to_pylist()
    width = np.array([len(x) for x in raw])

    def tile(lo, hi):
        held = {}  # for each width: places, and their counts in that width and in half of it
        for w in np.unique(width[lo:hi]).tolist():
            at = np.flatnonzero(width[lo:hi] == w)
            full = np.frombuffer(b"".join(raw[lo + i] for i in at.tolist()), np.uint8).reshape(-1, w).astype(np.int16)
            held[w] = at, full, np.minimum(full.reshape(-1, 2, w // 2).sum(axis=1, dtype=np.int16), 255)
        place = {int(i): k for at, _, _ in held.values() for k, i in enumerate(at)}

        def near(i):
            out = np.zeros(hi - lo - i - 1, bool)
            w, k = int(width[lo + i]), place[i]
            own = held[w]
            for v in (w // 2, w, 2 * w):
                if v in held:
                    at = held[v][0]
                    first = int(np.searchsorted(at, i, "right"))
                    theirs, mine = (held[v][1], own[1][k]) if v == w else (held[v][1], own[2][k]) if v < w else (held[v][2], own[1][k])
                    apart = np.abs(theirs[first:] - mine).sum(axis=1, dtype=np.int64)
                    out[at[first:] - i - 1] = (least.denominator + least.numerator) * apart <= (least.denominator - least.numerator) * (n[lo + i] + n[lo + at[first:]])
            return out

        return near

    return tile


def by_sets(rows, least: Fraction):
    """Rows (..., n, hashes) -> the same for sets that are near."""
    import numpy as np

    n = rows.column(4).to_numpy().astype(np.int64)
    flat = np.concatenate([x.flatten().to_numpy() for x in rows.column(5).chunks])
    ends = np.r_[0, np.cumsum(n)]

    def tile(lo, hi):
        ids = np.unique(flat[ends[lo] : ends[hi]], return_inverse=True)[1]
        mark = np.zeros(int(ids.max()) + 1, np.int32)
        at = ends[lo : hi + 1] - ends[lo]

        def near(i):
            mark[ids[at[i] : at[i + 1]]] = 1
            both = np.add.reduceat(mark[ids[at[i + 1] :]], at[i + 1 : -1] - at[i + 1])
            mark[ids[at[i] : at[i + 1]]] = 0
            return least.denominator * both >= least.numerator * (n[lo + i] + n[lo + i + 1 : hi] - both)

        return near

    return tile


def tile_links(side, near):
    """A spanning forest of the pairs of one tile that are near, as positions."""
    import numpy as np

    m = len(side)
    group = np.arange(m)
    out = []
    for i in range(m - 1):
        able = (group[i + 1 :] != group[i]) & ((side[i] == 2) | (side[i + 1 :] != side[i]))
        if not able.any():
            continue
        for x in (np.flatnonzero(able & near(i)) + i + 1).tolist():
            if group[x] != group[i]:
                out.append((i, x))
                group[group == group[x]] = group[i]
    return out


def _linked(rule, least: Fraction):
    """Rows (list, tile, side, fp, ...) sorted by list and tile -> links of each tile's spanning forest."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            if not rows.num_rows:
                continue
            at, tile = (rows.column(i).to_numpy() for i in (0, 1))
            other = np.flatnonzero((at != at[-1]) | (tile != tile[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last tile may go on in the next batch
            held = rows.slice(cut)
            if cut:
                yield out(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield out(held)

    def out(rows):
        import numpy as np
        import pyarrow as pa

        at, tile, side, fp = (rows.column(i).to_numpy() for i in range(4))
        near = rule(rows, least)
        change = np.flatnonzero((at[1:] != at[:-1]) | (tile[1:] != tile[:-1])) + 1
        a, b = [], []
        for lo, hi in zip(np.r_[0, change].tolist(), np.r_[change, len(at)].tolist(), strict=True):
            for i, j in tile_links(side[lo:hi], near(lo, hi)):
                a.append(fp[lo + i])
                b.append(fp[lo + j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work


def tiled(lists: DataFrame, held: DataFrame, rule, least: Fraction, block: int) -> DataFrame:
    """``lists(list, fp)`` and ``held(fp, n, ...)`` -> ``(a, b)``: forests of the pairs of a list that are near by ``rule``."""
    sizes = written(lists.groupBy("list").count().where("count > 1").select("list", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "near-sizes")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # a block meets itself (side 2) and each other block (side 0 or 1)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = lists.join(sizes, "list").select("list", "blocks", "fp", own.alias("own"), other)
    tile = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    tiles = tiles.select("list", tile.alias("tile"), side.cast("int").alias("side"), "fp").join(held, "fp")
    dealt = tiles.select("list", "tile", "side", *held.columns).repartition("list", "tile").sortWithinPartitions("list", "tile")
    return dealt.mapInArrow(_linked(rule, least), "a long, b long")


def links(docs: DataFrame, sets: DataFrame, text: str, words: int, seed: int, least: Fraction = LEAST, block: int = 256) -> DataFrame:
    """``docs`` and their ``sets(k, h, fp, n, counts, lists)`` -> ``(a, b)``: links that join whatever near copies join."""
    marks = written(sets.where("n > 0").dropDuplicates(["fp"]), "near-marks")
    lists = marks.select("fp", F.explode("lists").alias("list"))
    rough = written(components(tiled(lists, marks.select("fp", "n", "counts"), by_counts, least, block), "near-cc"), "near-rough")
    chosen = written(marks.select("k", "h", "fp").join(rough, F.col("fp") == F.col("node")).select(F.col("k").alias("mk"), F.col("h").alias("mh"), "component", "fp"), "near-chosen")
    held = docs.join(chosen, F.col("k").eqNullSafe(F.col("mk")) & (F.col("h") == F.col("mh")), "left_semi").select(text).mapInArrow(_sets(text, words, seed), "fp long, n int, hashes array<long>")
    # a hash of the text that two texts share brings a set too many, which no list names
    return tiled(chosen.select(F.col("component").alias("list"), "fp"), written(held.dropDuplicates(["fp"]), "near-held"), by_sets, least, block)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 5, seed: int = 42, least: Fraction = LEAST, block: int = 256) -> DataFrame:
    """-> key, ``fp`` (a hash of the set) and ``component``, the smallest key that links reach."""
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("k"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("h"), F.col(text).alias("text"))
    cells = docs.sparkSession.sparkContext.broadcast(frequent(docs, "text", words, seed))
    sets = written(docs.mapInArrow(_prefixes(["k", "h"], "text", words, seed, least, cells), f"k {kind}, h long, fp long, n int, counts binary, lists array<long>"), "near-sets")
    return named(sets.select(F.col("k").alias(key), "fp"), links(docs, sets, "text", words, seed, least, block), key)
