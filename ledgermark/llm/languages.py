"""Language identification by words: script ranges, n-gram scores, and Viterbi over a text.

A text's words are runs of letters of one script. A word's script leaves the languages
that were seen to use it; each of these scores the word by the log probability of its
grams of two to four letters, word ends included, hashed to :data:`BUCKETS` counts a
language. A Viterbi search over the words, where a change of language costs ``penalty``,
labels spans; the language with most letters is the text's, and its share of the letters
is the score.

Learning counts grams and scripts over all labelled rows, added up within each partition
before anything is shuffled; a language is one vector of fixed size, so what is
broadcast is bounded by the number of languages (``most``; more raise an error).
Prediction shuffles nothing. Texts go whole, in pieces of 65,536 letters; the words of
a batch of short texts are searched side by side.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything
if nothing was learned; letters of a script that no language uses tell nothing, and a
text of them alone has the commonest language and score 0; ties go to the language
first by code point; a word of over 65,536 letters counts as several; repeated rows
give repeated results; rows without label or text teach nothing; an empty table gives an
empty result; extra columns are not read. A null id counts as the id of no characters.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import slices, table, written

#: The Unicode blocks of scripts, first and last code point; letters outside are of script 0.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "Han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
#: Of a language's letters, the share that a script has if the language uses it.
USED = 0.01
SMOOTH = 0.5
PIECE = 1 << 16
UNKNOWN = "und"


@cache
def characters():
    """By code point: whether it belongs to a word, whether it is a letter, its lower case, its script."""
    import unicodedata

    import numpy as np

    n = 0x110000
    letter = np.fromiter((chr(c).isalpha() for c in range(n)), bool, n)
    mark = np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x20000)), bool, 0x20000)
    word = letter.copy()
    word[:0x20000] |= mark
    fold = np.arange(n, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            fold[c] = ord(low)
    script = np.zeros(n, np.int8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return word, letter, fold, script


class Words:
    """The words of an array of code points: first and end places, letters, script, and hashed grams by letter."""

    def __init__(self, code):
        import numpy as np

        is_word, is_letter, fold, script_of = characters()
        inside = is_word[code]
        self.at = at = np.flatnonzero(inside)
        kind = script_of[code[at]]
        letter = is_letter[code[at]]
        if len(at):  # marks go with the letter before
            last = np.maximum.accumulate(np.where(letter, np.arange(len(at)), 0))
            kind = np.where(letter, kind, kind[last])
            begins = np.r_[True, (np.diff(at) != 1) | (kind[1:] != kind[:-1])]
        else:
            begins = np.empty(0, bool)
        self.first = np.flatnonzero(begins)  # in at
        self.start = at[self.first]
        self.end = at[np.r_[self.first[1:], len(at)][: len(self.first)] - 1] + 1
        self.script = kind[self.first]
        self.letters = np.add.reduceat(letter.astype(np.int64), self.first) if len(at) else np.empty(0, np.int64)
        self.code = np.zeros(len(code) + 4, np.uint64)
        self.code[1 : len(code) + 1][inside] = fold[code[inside]]

    def grams(self):
        """For each kind of gram: the places in ``at`` that begin one, and its bucket."""
        import numpy as np

        code, at = self.code, self.at + 1
        mix = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
        h = code[at - 1] * mix[0] + code[at] * mix[1]
        yield np.arange(len(at)), _bucket(h, 2)
        h = h + code[at + 1] * mix[2]
        yield np.arange(len(at)), _bucket(h, 3)
        long = np.flatnonzero(code[at + 1] > 0)
        yield long, _bucket(h[long] + code[at[long] + 2] * mix[3], 4)


def _bucket(h, size: int):
    import numpy as np

    h = (h + np.uint64(size)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return ((h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(48)).astype(np.int64)


def pieces(texts: list):
    """Texts end to end with a break between, as arrays of at most :data:`PIECE` code points and their offsets."""
    import numpy as np

    flat = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word, a = characters()[0], 0
    while a < len(flat):
        b = min(len(flat), a + PIECE)
        if b < len(flat):
            gap = np.flatnonzero(~is_word[flat[a:b]])
            b = a + int(gap[-1]) + 1 if len(gap) else b
        yield a, flat[a:b]
        a = b


def _counted(text: str, label: str):
    size = BUCKETS + len(SCRIPTS) + 1

    def work(batches):
        import numpy as np
        import pyarrow as pa

        counts: dict = {}

        def rows():
            for lang, n in counts.items():
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(n[hit], pa.int64())], names=["lang", "bucket", "n"])
            counts.clear()

        for batch in slices(batches, text, 1_000_000):
            by: dict = {}
            for x, lang in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index(label)).to_pylist(), strict=True):
                if x:
                    by.setdefault(lang, []).append(x)
            for lang, texts in by.items():
                n = counts.setdefault(lang, np.zeros(size, np.int64))
                for _, code in pieces(texts):
                    words = Words(code)
                    for _, bucket in words.grams():
                        n[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(words.script, words.letters, size - BUCKETS).astype(np.int64)
            if len(counts) > 64:
                yield from rows()
        yield from rows()

    return work


def _vector(pdf):
    """One language's counts as a row of log probabilities and scripts."""
    import numpy as np
    import pandas as pd

    n = np.zeros(BUCKETS + len(SCRIPTS) + 1)
    n[pdf["bucket"].to_numpy()] = pdf["n"].to_numpy()
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    logs = np.log((grams + SMOOTH) / (grams.sum() + SMOOTH * BUCKETS)).astype(np.float32)
    uses = scripts >= USED * max(1.0, scripts.sum())
    return pd.DataFrame({"lang": pdf["lang"][:1], "logs": [logs.tobytes()], "scripts": [uses.astype(np.uint8).tobytes()], "letters": [int(scripts.sum())]})


def learned(docs: DataFrame, text: str = "text", label: str = "lang", most: int = 1000):
    """A model from all of ``docs`` with a text and a label: languages, log probabilities, scripts, letters."""
    import numpy as np

    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    counts = rows.mapInArrow(_counted("text", "lang"), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = written(counts.groupBy("lang").applyInPandas(_vector, "lang string, logs binary, scripts binary, letters long"), "languages")
    n = model.count()
    if n > most:
        raise ValueError(f"{n} languages, over {most}")
    rows = sorted((r for r in model.collect() if r.letters), key=lambda r: r.lang)
    if not rows:
        return None
    return {
        "langs": [r.lang for r in rows], "logs": np.stack([np.frombuffer(r.logs, np.float32) for r in rows], 1),
        "scripts": np.stack([np.frombuffer(r.scripts, np.uint8) for r in rows], 1).astype(bool), "letters": np.array([r.letters for r in rows], np.float64),
    }


def scored(model: dict, texts: list):
    """Words of texts end to end: first and end places, letters, whether they tell anything, and a score for each language."""
    import numpy as np

    logs, uses = model["logs"], model["scripts"]
    out = []
    for offset, code in pieces(texts):
        w = Words(code)
        each = None
        for place, bucket in w.grams():
            got = logs.take(bucket, axis=0)
            if each is None:
                each = got
            elif len(place) == len(each):
                each += got
            else:
                each[place] += got
        score = np.add.reduceat(each, w.first) / len(GRAMS) if len(w.first) else np.empty((0, logs.shape[1]), np.float32)
        allowed = uses[w.script]
        tells = allowed.any(1) & (w.letters > 0)
        score -= score.max(1, keepdims=True, initial=-np.inf, where=allowed) if len(score) else 0
        score = np.where(tells[:, None], np.where(allowed, score, np.float32(-1e6)), np.float32(0))
        out.append((w.start + offset, w.end + offset, w.letters, tells, score))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty((0, logs.shape[1]), np.float32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_labels(score, cut, prior, penalty: float):
    """Viterbi labels of the words of each text ``cut[k]:cut[k + 1]``, all texts side by side."""
    import numpy as np

    size = np.diff(cut)
    order = np.argsort(-size, kind="stable")
    first, size = cut[:-1][order], size[order]
    n = int(np.searchsorted(-size, 0, "left"))
    label = np.zeros(len(score), np.int16)
    if not n:
        return label
    live = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")  # texts with more than t words
    back = np.empty(score.shape, np.int16)
    langs = np.arange(score.shape[1], dtype=np.int16)
    path = prior + score[first[:n]].astype(np.float64)
    ended = np.empty(n, np.int16)
    for t in range(1, int(size[0])):
        m = int(live[t])
        ended[m : len(path)] = path[m:].argmax(1)
        path = path[:m]
        top = path.argmax(1)
        change = path[np.arange(m), top][:, None] - penalty
        stay = path >= change
        at = first[:m] + t
        back[at] = np.where(stay, langs, top[:, None])
        path = np.where(stay, path - change, 0.0) + score[at]
    ended[: len(path)] = path.argmax(1)
    last = first[:n] + size[:n] - 1
    label[last] = ended
    for t in range(int(size[0]) - 1, 0, -1):
        at = first[: int(live[t])] + t
        label[at - 1] = back[at, label[at]]
    return label


def _labelled(shared, key: str, text: str, penalty: float, with_spans: bool):
    def work(batches):
        import numpy as np
        import pyarrow as pa

        model = shared.value
        # a word has a score for each language; few large batches make few steps of the search
        most = max(250_000, 16_000_000 // len(model["langs"])) if model else 1_000_000
        for batch in slices(batches, text, most):
            keys, texts = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index(text)).to_pylist()
            texts = [x or "" for x in texts]
            n = len(texts)
            lang, share, spans = [UNKNOWN] * n, np.zeros(n), [[]] * n
            if model is not None:
                begins = np.cumsum([0, *[len(x) + 1 for x in texts]])
                start, end, letters, tells, score = scored(model, texts)
                cut = np.searchsorted(start, begins)
                label = best_labels(score, cut, np.log(model["letters"] / model["letters"].sum()), penalty)
                names = model["langs"]
                doc = np.searchsorted(begins, start, "right") - 1
                cell = doc * len(names) + label
                # words that tell nothing count only where no word tells anything, and never for the score
                told = np.bincount(cell, np.where(tells, letters, 0), n * len(names)).reshape(n, -1)
                held = np.bincount(cell, letters, n * len(names)).reshape(n, -1)
                total = held.sum(1)
                use = np.where(told.any(1)[:, None], told, held)
                best = use.argmax(1)
                share = np.where(total > 0, told[np.arange(n), best] / np.maximum(total, 1), 0.0)
                lang = [names[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist(), strict=True)]
                if with_spans:
                    new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
                    spans = [[] for _ in range(n)]
                    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(cell)], strict=True):
                        d = int(doc[a])
                        spans[d].append({"start": int(start[a] - begins[d]), "end": int(end[b - 1] - begins[d]), "lang": names[label[a]]})
            cols, columns = [keys, pa.array(lang, pa.string()), pa.array(share, pa.float64())], [key, "lang_pred", "score"]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                columns.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return work


def identify(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text", penalty: float = 8.0, with_spans: bool = True) -> DataFrame:
    """-> key, lang_pred, score and, ``with_spans``, the spans of the text (places in code points) with their languages."""
    kind = docs.schema[key].dataType.simpleString()
    more = ", spans array<struct<start: long, end: long, lang: string>>" if with_spans else ""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(key, text).mapInArrow(_labelled(shared, key, text, penalty, with_spans), f"`{key}` {kind}, lang_pred string, score double{more}")


def fold_of(key: Column) -> Column:
    """The fold of a document, 0 to 2; 1 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs.where(fold_of(F.col("doc_id")) != 1))
    out = identify(docs, model, with_spans=False)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
