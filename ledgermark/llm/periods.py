"""Periodic runs of words: difference-cover LCE and a harmonic grid.

A run is a stretch of words with smallest period q, as long as ``least`` words and two
periods, that neither neighbour extends. It covers two neighbouring points of the grid
0, q, 2q, ..., so that n * (1 + 1/2 + 1/3 + ...) pairs of points (i, i + q) show every run
of a text of n words; how far both sides agree forward and backward gives its ends.

Most pairs differ within a few words, which are compared as they stand. For the rest,
the texts that hold them get two structures, one for each direction: the suffixes at
positions of a difference cover (4 of any 13) are sorted, by their first 13 words and then
by doubling among themselves; neighbours' common lengths go into a sparse table. Two
positions are moved on by less than 13 words, compared on the way, until both are in
the cover; the table's minimum between their ranks is what they share from there.

A text is one row and stays in one task, with some 200 bytes a word while it is worked on;
short texts go through together. Nothing is shuffled.

Cases: null and empty texts have no words, no runs and an empty collapsed text; a word is
a run of other than space, tab, LF, VT, FF, CR; repeated rows give repeated results; an
empty table gives an empty result; other columns are not read. In the query a null id
leaves the words as they are.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import slices, table

#: A perfect difference cover: every difference modulo 13 is one of two of these.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words compared as they stand before a pair is left to the structures.
NEAR = 12
#: Pairs of grid points at a time.
PAIRS = 2_000_000


class Lce:
    """Longest common extensions of positions in an array of numbers that ends in a number of its own."""

    def __init__(self, words):
        import numpy as np

        v, k = MODULUS, len(COVER)
        n = len(words)
        blocks = -(-n // v)
        own = np.arange(blocks * v + 2 * v - n) + (int(words.max()) + 1 if n else 0)
        self.words = w = np.concatenate([words, own])
        self.slot = np.full(v, -1, np.int64)
        self.slot[list(COVER)] = np.arange(k)
        self.to = np.zeros(v, np.int64)  # by difference: the residue to which the first of two positions moves
        for x in COVER:
            for y in COVER:
                self.to[(y - x) % v] = x
        at = (np.arange(blocks)[:, None] * v + np.array(COVER)).ravel()
        size = len(at)

        first = np.argsort(w[at], kind="stable")
        rank = np.empty(size, np.int64)
        rank[first] = _starts(w[at][first])
        open_ = first[_tied(rank[first])]

        def refine(open_, key):
            both = rank[open_] * (int(key.max()) + 1) + key
            o = np.argsort(both, kind="stable")
            open_, both, old = open_[o], both[o], rank[open_[o]]
            rank[open_] = old + _starts(both) - _starts(old)
            return open_[_tied(rank[open_])]

        for t in range(1, v):
            if not len(open_):
                break
            open_ = refine(open_, w[at[open_] + t])
        levels = [rank.copy()]  # by the first 13 words, the first 26, 52, ...
        step = k
        while len(open_):
            beyond = open_ + step
            key = np.where(beyond < size, levels[-1][np.minimum(beyond, size - 1)] + 1, 0)
            open_ = refine(open_, key)
            levels.append(rank.copy())
            step *= 2
        order = np.empty(size, np.int64)
        order[rank] = np.arange(size)
        a, b = order[:-1].copy(), order[1:].copy()
        same = np.zeros(len(a), np.int64)
        for j in range(len(levels) - 2, -1, -1):
            level = levels[j]
            hit = np.flatnonzero((a < size) & (b < size) & (level[np.minimum(a, size - 1)] == level[np.minimum(b, size - 1)]))
            same[hit] += v << j
            a[hit] += k << j
            b[hit] += k << j
        del levels
        a, b = at[order[:-1]] + same, at[order[1:]] + same
        left = np.arange(len(a))
        for _ in range(v):
            left = left[w[a[left]] == w[b[left]]]
            same[left] += 1
            a[left] += 1
            b[left] += 1
        self.rank = rank
        self.least = [same.astype(np.int32) if n < 2**31 else same]
        while 2 ** len(self.least) <= len(same):
            last, half = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def of(self, i, j):
        """How many words positions ``i`` and ``j`` (none equal) have in common from there on."""
        import numpy as np

        v = MODULUS
        move = (self.to[(j - i) % v] - i) % v
        got = np.zeros(len(i), np.int64)
        left = np.arange(len(i))
        for t in range(v):
            going = left[move[left] > t]
            differs = self.words[i[going] + t] != self.words[j[going] + t]
            got[going[~differs]] += 1
            left = np.concatenate([left[move[left] <= t], going[~differs]])
            if not len(going):
                break
        a, b = i[left] + move[left], j[left] + move[left]
        a = self.rank[a // v * len(COVER) + self.slot[a % v]]
        b = self.rank[b // v * len(COVER) + self.slot[b % v]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        for p in np.unique(power).tolist():
            hit = power == p
            row = self.least[p]
            got[left[hit]] += np.minimum(row[low[hit]], row[high[hit] - 2**p])
        return got


def _starts(sorted_):
    """For each entry of a sorted array the place where its equals begin."""
    import numpy as np

    new = np.r_[True, sorted_[1:] != sorted_[:-1]][: len(sorted_)]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_)), 0))


def _tied(grouped):
    """Marks entries of an array of groups whose group has others."""
    import numpy as np

    same = grouped[1:] == grouped[:-1]
    return np.r_[False, same][: len(grouped)] | np.r_[same, False][: len(grouped)]


def _joined(texts: list):
    """Number arrays end to end, each followed by a number of its own; and where each begins."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    out = np.empty(int(sizes.sum()) + len(texts), np.int64)
    top = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    for k, t in enumerate(texts):
        out[first[k] : first[k] + len(t)] = t
        out[first[k] + len(t)] = top + k
    return out, first


def runs_of(texts: list, least: int = 12):
    """Runs of arrays of word numbers: arrays text, start, length, period, by text, start and period."""
    import numpy as np

    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    texts = [texts[k] for k in order]  # longest first: a period meets a prefix of the joined texts
    sizes = np.array([len(t) for t in texts], np.int64)
    words, first = _joined(texts)
    n = len(words)
    top = int(words.max()) + 1 if n else 0
    room = np.arange(2 * NEAR) + top
    padded = np.concatenate([room[:NEAR], words, room[NEAR:]])
    found = []

    def keep(i, p, back, ahead):
        hit = back + ahead >= np.maximum(p, least - p)
        i, p, back, ahead = i[hit], p[hit], back[hit], ahead[hit]
        text = np.searchsorted(first, i, "right") - 1
        found.append((text, i - back - first[text], back + ahead + p, p))

    later = []

    def grid(i, p):
        """Pairs that differ within a few words both ways are settled; others wait for the structures."""
        ahead, back = np.ones(len(i), np.int64), np.zeros(len(i), np.int64)
        for side, sign in ((ahead, 1), (back, -1)):
            left = np.arange(len(i))
            for t in range(1, NEAR):
                at = i[left] + NEAR + sign * t
                left = left[padded[at] == padded[at + p[left]]]
                side[left] += 1
        # what stopped short of NEAR is exact: ahead from 1, back from 0
        exact = (ahead < NEAR) & (back < NEAR - 1)
        keep(i[exact], p[exact], back[exact], ahead[exact])
        i, p = i[~exact], p[~exact]
        text = np.searchsorted(first, i, "right") - 1
        inside = i + p < first[text] + sizes[text]  # no run reaches into the next text
        later.append((i[inside], p[inside]))

    waiting, held = [], 0
    for p in range(1, int(sizes[0]) // 2 + 1 if len(sizes) else 1):
        upto = int(np.searchsorted(-sizes, -2 * p, "right"))
        end = int(first[upto - 1] + sizes[upto - 1])
        i = np.flatnonzero(words[: end - p : p] == words[p:end:p]) * p
        if len(i):
            waiting.append((i, np.full(len(i), p, np.int64)))
            held += len(i)
            if held > PAIRS:
                grid(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, held = [], 0
    if waiting:
        grid(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
    if later:
        i, p = (np.concatenate(x) for x in zip(*later, strict=True))
        if len(i):
            text = np.searchsorted(first, i, "right") - 1
            some = np.unique(text)
            part, begins = _joined([texts[k] for k in some.tolist()])
            moved = i - first[text] + begins[np.searchsorted(some, text)]
            both, m = [], len(part)
            ahead = Lce(part)
            for at in range(0, len(i), PAIRS):
                x = slice(at, at + PAIRS)
                both.append(ahead.of(moved[x], moved[x] + p[x]))
            del ahead
            back = Lce(np.concatenate([part[::-1], [int(part.max()) + 1]]))
            for k, at in enumerate(range(0, len(i), PAIRS)):
                x = slice(at, at + PAIRS)
                # the words before i and before i + p, from there to the left
                keep(i[x], p[x], back.of(m - moved[x], m - moved[x] - p[x]), both[k])
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    text, start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((period, length, start, text))
    text, start, length, period = text[o], start[o], length[o], period[o]
    new = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(text)]
    text, start, length, period = np.array(order, np.int64)[text[new]], start[new], length[new], period[new]
    o = np.lexsort((period, start, text))
    return text[o], start[o], length[o], period[o]


def kept_words(n: int, start, length, period):
    """Marks the words that no run contains after its first period."""
    import numpy as np

    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:n] == 0


def repeated_tail(key, words: list) -> list:
    """The query's rewriting: of one text in ten the words from some place on become repeats of what begins there."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _found(key: str, text: str, least: int, rewrite):
    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, text, 1_000_000):
            keys = batch.column(batch.schema.get_field_index(key))
            words = [x.encode().split() if x else [] for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            if rewrite is not None:
                words = [rewrite(k, w) for k, w in zip(keys.to_pylist(), words, strict=True)]
            number: dict[bytes, int] = {}
            ids = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words]
            which, start, length, period = runs_of(ids, least)
            cut = np.searchsorted(which, np.arange(len(words) + 1))
            collapsed = []
            for k, ws in enumerate(words):
                x = slice(cut[k], cut[k + 1])
                if cut[k] < cut[k + 1]:
                    ws = [ws[i] for i in np.flatnonzero(kept_words(len(ws), start[x], length[x], period[x])).tolist()]
                collapsed.append(b" ".join(ws).decode())
            each = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), each)
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(w) for w in words], pa.int64()), runs, pa.array(collapsed, pa.string())], names=[key, "n_words", "runs", "collapsed"])

    return work


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12, rewrite=None) -> DataFrame:
    """-> key, n_words, runs (start, length and period in words, by start and period) and collapsed, the text without the repeats.

    ``rewrite(key, words)`` may change a text's words, as bytes, before the search.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_found(key, text, least, rewrite), f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeated_tail)
    # the greatest length, then the smallest start and period
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(y["length"] > x["length"], y).otherwise(x))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")
    ).select("doc_id", "n_runs", "_b.start", "_b.length", "_b.period", F.floor(1000 * F.col("_b.length") / F.col("_b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: The same by gaps and islands: six equal words in a row at a distance p are part of every run of period p,
#: as length - p is at least max(12 - p, p), so 6 or more. DuckDB has no CRC-32, so it is worked out bit by bit.
OP11_SQL = r"""
WITH RECURSIVE ids AS MATERIALIZED (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS t FROM documents WHERE doc_id IS NOT NULL
), bits(doc_id, t, k, c) AS (
  SELECT doc_id, t, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT doc_id, t, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, ascii(t[k // 9 + 1])::BIGINT)
    WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END
  FROM bits WHERE k < 9 * length(t)
), crc AS MATERIALIZED (
  SELECT doc_id, xor(c, 4294967295::BIGINT) AS h FROM bits WHERE k = 9 * length(t)
), given AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), marked AS (
  SELECT r, doc_id, ws, len(ws) AS n, coalesce(h % 10 = 0 AND len(ws) > 0, false) AS hit, (h // 10) % greatest(1, len(ws)) AS a, h // 10 AS g FROM given LEFT JOIN crc USING (doc_id)
), sized AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM marked
), rebuilt AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: ws[(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1)::BIGINT]) ELSE ws END AS ws FROM sized
), grams AS MATERIALIZED (
  SELECT r, i, array_to_string(ws[i + 1 : i + 6], ' ') AS gram FROM rebuilt, unnest(range(n - 5)) AS _(i) WHERE n >= 12
), equal AS (
  SELECT x.r, x.i, y.i - x.i AS p FROM grams x JOIN grams y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i
), islands AS (
  SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM equal
), stretches AS (
  SELECT r, p, min(i) AS "start", count(*) + 5 + p AS "length" FROM islands GROUP BY r, p, island
), runs AS MATERIALIZED (
  SELECT r, "start", "length", min(p) AS period FROM stretches WHERE "length" >= greatest(12, 2 * p) GROUP BY r, "start", "length"
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg("start" || ',' || "length" || ',' || period || chr(10), '' ORDER BY "start", period) AS txt,
    arg_min({'s': "start", 'l': "length", 'p': period}, ("length" * -1, "start", period)) AS b FROM runs GROUP BY r
), dropped AS (
  SELECT DISTINCT r, unnest(range("start" + period, "start" + "length")) AS i FROM runs
), gone AS (
  SELECT r, list(i) AS gone FROM dropped GROUP BY r
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS txt FROM (
    SELECT rebuilt.r, i, ws[i + 1] AS w FROM rebuilt, unnest(range(n)) AS _(i) WHERE r IN (SELECT r FROM gone)
  ) ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT rebuilt.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS "start", b.l AS "length", b.p AS period, (1000 * b.l) // b.p AS exponent_milli,
  sha256(coalesce(listed.txt, '')) AS runs_sha256, sha256(CASE WHEN n_runs IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept.txt, '') END) AS collapsed_sha256
FROM rebuilt LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
