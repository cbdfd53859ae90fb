"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every place where ``window`` bytes of a document begin is a suffix to be ordered through
``window`` bytes only; places that share those bytes are the repeated windows, and each
byte they cover goes. The sort is most-significant-digit first:

* The first digit is a function of the window alone: the least hash of its ``gram``-byte
  substrings. Runs of consecutive windows with one such digit travel as one span, named
  by a hash of its bytes. Digits that occur once are done: no other window has them.
* Equal spans are counted. Of a span that occurs twice, all windows repeat.
* What is left are spans that share the digit but differ, at the edges of repeated
  passages. Their windows are ordered by their bytes, eight at a time; groups of one
  leave after each pass, groups with one digit need no sorting, and groups that reach
  the full depth are exactly the repeated windows.

A digit that many different spans share is cut into blocks of ``block`` spans, which meet
pairwise. Texts travel once; the exchange that deals them out is reused by both joins.

Cases: null and empty texts have no bytes and nothing removed; texts shorter than a
window lose nothing; windows never cross documents, overlapping ones count, also within
one text of any length; repeated rows are documents of their own, so both lose what they
share; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import flat_bytes, slices, table, written
from ledgermark.llm.lines import boxed, joined, whole

LONG = 2048  # windows in a span at most; a longer run becomes several


def sliding(op, x, width: int):
    """``op`` (minimum or maximum) over ``width`` elements from each place on; places near the end are cut off."""
    have, y = 1, x
    while 2 * have <= width:
        y = op(y[:-have], y[have:])
        have *= 2
    return op(y[: len(y) - (width - have)], y[width - have :]) if have < width else y


def gram_hashes(data, gram: int):
    """A 64-bit hash, never 0, of the ``gram`` bytes (a power of two) at each place."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        have = 1
        while have < gram:
            h = h[:-have] * np.uint64(0xD6E8FEB86659FD93) + h[have:]
            h ^= h >> np.uint64(31)
            have *= 2
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ h >> np.uint64(33) | np.uint64(1)


def spans(data, ends, window: int, gram: int):
    """Spans of documents that lie end to end.

    Returns arrays: document, first place in it, number of windows, digit, hash of the
    bytes, and whether the digit comes from two places of the span.
    """
    import numpy as np

    from ledgermark.llm.xxh import xxh64

    none = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2 + [np.empty(0, bool)]
    if len(data) < window:
        return none
    width = window - gram + 1
    h = gram_hashes(data, gram)
    least = sliding(np.minimum, h, width)  # one for each place where a window begins
    size = np.diff(ends)
    doc = np.repeat(np.arange(len(size)), size)[: len(least)]
    valid = np.arange(len(least)) + window <= ends[doc + 1]
    least = np.where(valid, least, np.uint64(0))
    # the places whose hash is the least of some window
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(h == sliding(np.maximum, padded, width)[: len(h)])
    change = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(change)
    count = np.diff(np.r_[first, len(least)])
    first, count = first[least[first] != 0], count[least[first] != 0]
    pieces = -(-count // LONG)
    if (pieces > 1).any():
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        count = np.minimum(LONG, np.repeat(count, pieces) - k * LONG)
        first = np.repeat(first, pieces) + k * LONG
    digit = least[first]
    # does the digit come from two places that the span covers?
    a, b = np.searchsorted(chosen, first), np.searchsorted(chosen, first + count - 1 + width)
    each = b - a
    at = np.repeat(a - (np.cumsum(each) - each), each) + np.arange(each.sum())
    same = h[chosen[at]] == np.repeat(digit, each)
    twice = np.bincount(np.repeat(np.arange(len(first)), each)[same], minlength=len(first)) > 1
    name = xxh64(data, first, count + window - 1, 7)
    return doc[first], first - ends[doc[first]], count, digit, name, twice


def _spanned(window: int, gram: int):
    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "text", 1_000_000):
            data, ends = flat_bytes(batch.column(2))
            doc, at, count, digit, name, twice = spans(data, ends, window, gram)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(digit.view(np.int64)), pa.array(name.view(np.int64)), pa.array(twice)],
                names=["k", "h", "at", "n", "digit", "name", "twice"],
            )

    return work


def repeated(data, first, count, group, window: int):
    """Of spans' windows, those whose bytes another window of the same group has: a mask over all windows.

    ``data`` holds the spans' bytes, from ``first`` on for each, with ``window`` - 1 bytes
    behind its ``count`` windows.
    """
    import numpy as np

    from ledgermark.llm.xxh import words64

    wide = words64(data).byteswap()  # big-endian words order as their bytes do
    total = int(count.sum())
    place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
    member = np.arange(total)
    bucket = np.repeat(group, count)
    order = np.argsort(bucket, kind="stable")
    place, member, bucket = place[order], member[order], bucket[order]

    def alone(place, member, start):
        size = np.diff(np.r_[start, len(place)])
        keep = np.repeat(size > 1, size)
        label = np.repeat(np.arange(len(size)), size)[keep]
        return place[keep], member[keep], label

    place, member, bucket = alone(place, member, np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if total else np.empty(0, np.int64))
    for depth in range(0, window, 8):
        if not len(place):
            break
        digit = wide[place + depth]
        if window - depth < 8:
            digit = digit >> np.uint64(8 * (8 - window + depth))
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[start, len(bucket)])
        mixed = np.repeat(np.minimum.reduceat(digit, start) != np.maximum.reduceat(digit, start), size)
        todo = np.flatnonzero(mixed)
        if len(todo):
            sorting = todo[np.lexsort((digit[todo], bucket[todo]))]
            place[todo], member[todo], digit[todo] = place[sorting], member[sorting], digit[sorting]
            split = np.r_[True, (bucket[1:] != bucket[:-1]) | (digit[1:] != digit[:-1])]
            place, member, bucket = alone(place, member, np.flatnonzero(split))
    out = np.zeros(total, bool)
    out[member] = True
    return out


def _compared(window: int):
    """Rows (digit, tile, k, h, at, n, open, bytes) sorted by digit and tile -> (mk, mh, a, b) to remove."""

    def found(rows):
        import numpy as np
        import pyarrow as pa

        data, ends = flat_bytes(rows.column(rows.schema.get_field_index("bytes")))
        col = lambda name: rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        digit, tile, n, at = col("digit"), col("tile"), col("n").astype(np.int64), col("at").astype(np.int64)
        group = np.cumsum(np.r_[0, (digit[1:] != digit[:-1]) | (tile[1:] != tile[:-1])])
        hit = repeated(data, ends[:-1], n, group, window)
        span = np.repeat(np.arange(len(n)), n)
        hit &= col("open")[span]
        place = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
        # runs of repeated windows of one span
        on = np.flatnonzero(hit)
        begin = np.r_[True, (np.diff(on) != 1) | (span[on[1:]] != span[on[:-1]])] if len(on) else np.empty(0, bool)
        a = on[begin]
        b = on[np.r_[begin[1:], True]] if len(on) else on
        at_rows = pa.array(span[a])
        start = at[span[a]] + place[a]
        stop = at[span[a]] + place[b] + window
        names = ["mk", "mh", "a", "b"]
        return pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("k")).take(at_rows), rows.column(rows.schema.get_field_index("h")).take(at_rows), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=names)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks().to_batches()[0]
            digit, tile = (whole.column(whole.schema.get_field_index(c)).to_numpy() for c in ("digit", "tile"))
            other = np.flatnonzero((digit != digit[-1]) | (tile != tile[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            held = whole.slice(cut)
            # whole groups, a thousand spans or so at a time
            at = 0
            while at < cut:
                to = min(cut, at + 1000)
                while to < cut and digit[to] == digit[to - 1] and tile[to] == tile[to - 1]:
                    to += 1
                yield found(whole.slice(at, to - at))
                at = to
        if held is not None and held.num_rows:
            yield found(held)

    return work


def _removed():
    def work(batches):
        import pyarrow as pa

        for batch in slices(batches, "data"):
            n, gone, runs, digest, kept = [], [], [], [], []
            for data, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out, at, removed, count = [], 0, 0, 0
                for m in sorted((m["a"], m["b"]) for m in marks or ()):
                    if m[0] > at or not count:
                        out.append(data[at : m[0]])
                        count, removed, at = count + 1, removed + m[1] - m[0], m[1]
                    elif m[1] > at:
                        removed, at = removed + m[1] - at, m[1]
                rest = b"".join([*out, data[at:]])
                n.append(len(data))
                gone.append(removed)
                runs.append(count)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return work


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = 200, gram: int = 32, block: int = 4096) -> DataFrame:
    """-> key, n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the bytes that stay."""
    if window < 2 * gram:
        raise ValueError("a window holds two grams at least")
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(key, text)
    rows = boxed(docs, key, text)
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("h"), F.col(text).alias("text"))
    runs = written(slim.mapInArrow(_spanned(window, gram), f"k {kind}, h long, at int, n int, digit long, name long, twice boolean"), "suffix-spans")
    shared = runs.groupBy("digit").agg(F.count("*").alias("c"), F.max("twice").alias("twice")).where("c > 1 or twice").select("digit")
    runs = written(runs.join(written(shared, "suffix-digits"), "digit", "left_semi"), "suffix-shared")
    same = ["digit", "name", "n"]
    kinds = written(runs.groupBy(*same).agg(F.count("*").alias("c"), F.max("twice").alias("twice"), F.min(F.struct("k", "h", "at")).alias("where")), "suffix-kinds")
    copied = runs.join(kinds.where("c > 1").select(*same), same, "left_semi").select(F.col("k").alias("mk"), F.col("h").alias("mh"), F.col("at").alias("a"), (F.col("at") + F.col("n") + window - 1).alias("b"))

    left = kinds.groupBy("digit").agg(F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("open"), F.max("twice").alias("twice"))
    left = written(left.where("open > 0 and (kinds > 1 or twice)").select("digit", F.ceil(F.col("kinds") / block).cast("long").alias("blocks")), "suffix-left")
    asked = kinds.join(left, "digit").select("digit", "blocks", "name", "n", (F.col("c") == 1).alias("open"), "where.*")
    asked = asked.groupBy(F.col("k").alias("mk"), F.col("h").alias("mh")).agg(F.collect_set(F.struct("digit", "blocks", "name", "n", "open", "at")).alias("asked"))
    cut = joined(rows, asked, "inner").select("k", "h", F.encode(F.coalesce(whole()[text], F.lit("")), "UTF-8").alias("data"), F.explode("asked").alias("s"))
    cut = cut.select("k", "h", "s.*", F.substring("data", F.col("s.at") + 1, F.col("s.n") + (window - 1)).alias("bytes"))
    # rows that share key and text would bring one span twice
    own = F.pmod(F.xxhash64("name", "n"), F.col("blocks"))
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    cut = cut.select("digit", tile.alias("tile"), "k", "h", "at", "n", "open", "bytes").repartition("digit", "tile").sortWithinPartitions("digit", "tile")
    edges = cut.mapInArrow(_compared(window), f"mk {kind}, mh long, a int, b int")

    marks = copied.union(edges).groupBy("mk", "mh").agg(F.collect_set(F.struct("a", "b")).alias("marks"))
    out = joined(rows, marks).select(F.col("k").alias("key"), F.encode(F.coalesce(whole()[text], F.lit("")), "UTF-8").alias("data"), "marks")
    return out.mapInArrow(_removed(), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("key", key)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(len(h) // 2 - 199)) AS i, h FROM d WHERE len(h) >= 400),
k AS (SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS s FROM w),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM k) WHERE c > 1),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s)),
p AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, span),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM p),
c AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring((SELECT h FROM d WHERE d.r = q.r), 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substring(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN c USING (r)
"""
