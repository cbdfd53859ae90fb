"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece can cross (before a space run, around line feeds), each
batch's new words lie in flat numpy arrays of symbols, and every round finds each
word's minimum pair rank, merges its leftmost non-overlapping pairs of that rank and
compacts, until no pair of any word remains. That equals the library's queue (best
score first, leftmost on ties) as long as no merge makes a pair as good as the one it
came from beside another merge of the same round; words where that happens are done
again with one merge a round.

Only models of the kind used here are taken: BPE, identity normaliser, dummy prefix,
spaces escaped and kept, byte fallback, no user-defined or unused pieces, no piece with
a space behind another character. Others raise ValueError.

Cases: null is empty; empty text has no ids and decodes to empty text; U+2581 in a text
counts as a space, as in the library; repeated rows give repeated rows; an empty table
gives an empty result; extra columns are not read. Texts of any length go whole: words
are cached in a bounded table, and a word may be as long as the text.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import slices, table

CACHED = 400_000
NONE = 2**31 - 1


class Spelling:
    """Byte strings of ids, joined for whole arrays of ids at once."""

    def __init__(self, strings):
        import numpy as np

        strings = list(strings)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(x) for x in strings], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def of(self, ids, cut):
        """The strings of ``ids`` end to end, and the places in it of the places ``cut`` in ids."""
        import numpy as np

        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(self.first[ids] - ends[:-1], size) + np.arange(ends[-1])]
        return data.tobytes(), ends[cut]


class Model:
    """A model file's pieces, pair ranks and byte ids."""

    def __init__(self, path: str):
        import numpy as np
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, kinds = m.normalizer_spec, {p.type for p in m.pieces}
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or not m.trainer_spec.byte_fallback or kinds - {1, 2, 3, 6}:
            raise ValueError("not a BPE model with identity normaliser, dummy prefix and byte fallback")
        self.text = [p.piece for p in m.pieces]
        normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        if any(re.search("[^▁]▁", x) or ("\n" in x and x != "\n") for x in normal):
            raise ValueError("a piece crosses words")
        scores = sorted({m.pieces[i].score for i in normal.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        chars = {x: i for x, i in normal.items() if len(x) == 1}
        if any(c not in chars for x in normal for c in x):
            raise ValueError("a piece holds a character that is no piece")
        self.char = np.full(0x110000, -1, np.int32)
        for x, i in chars.items():
            self.char[ord(x)] = i
        pairs = {}
        for x, i in normal.items():
            for cut in range(1, len(x)):
                a, b = normal.get(x[:cut]), normal.get(x[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (order[m.pieces[i].score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        self.byte = np.zeros(256, np.int64)
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
        #: what an id decodes to; control pieces to nothing
        self.surface = Spelling(bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() if p.type == 1 else b"" if p.type == 3 else m.trainer_spec.unk_surface.encode() for p in m.pieces)
        self.decimal = Spelling(f"{i},".encode() for i in range(len(m.pieces)))
        self.words: dict[str, tuple[bytes, int, bytes]] = {}

    def ranks(self, left, right):
        """Positions in ``rank`` and ``made`` of the pairs (left, right)."""
        import numpy as np

        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        none = (self.keys[at] != key) | (left < 0) | (right < 0)
        at[none] = len(self.keys)
        return at.astype(np.int32)

    def merged(self, words: list[str], single: bool = False):
        """Arrays of word numbers, final symbols and the characters these start at, in order."""
        import numpy as np

        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum(sizes)])
        sym, at = self.char[code], np.arange(len(code)) - np.repeat(first[:-1], sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        ended, again = [], []

        def pairs(sym, word):
            got = np.full(len(sym), len(self.keys), np.int32)
            same = np.flatnonzero(word[1:] == word[:-1])
            got[same] = self.ranks(sym[same], sym[same + 1])
            return got

        pair = pairs(sym, word)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(word)])
            rank = self.rank[pair]
            least = np.minimum.reduceat(rank, starts)
            if (least == NONE).any():  # words without a pair left leave the arrays
                over = np.repeat(least == NONE, size)
                ended.append((word[over], sym[over], at[over]))
                word, sym, at, pair = word[~over], sym[~over], at[~over], pair[~over]
                continue
            low = np.repeat(least, size)
            hits = np.flatnonzero(rank == low)
            if single:
                hits = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
            else:  # of a run of overlapping pairs, every second one from the left
                run = np.r_[True, np.diff(hits) != 1]
                begin = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
                hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
            sym = sym.copy() if not sym.flags.writeable else sym
            sym[hits] = self.made[pair[hits]]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            old = low[hits]
            moved = np.cumsum(keep) - 1
            sym, word, at, pair = sym[keep], word[keep], at[keep], pair[keep]
            now = moved[hits]
            for side in (now, now - 1):  # the pairs on both sides of what was made
                ok = (side >= 0) & (side + 1 < len(sym))
                pos, was = side[ok], old[ok]
                same = word[pos] == word[pos + 1]
                pair[pos[~same]] = len(self.keys)
                pos, was = pos[same], was[same]
                pair[pos] = self.ranks(sym[pos], sym[pos + 1])
                if not single:
                    again.append(word[pos[self.rank[pair[pos]] <= was]])
            pair[-1] = len(self.keys)
        bad = np.unique(np.concatenate(again)) if again else np.empty(0, np.int64)
        if len(bad):
            ended = [tuple(x[keep] for x in part) for part in ended for keep in (~np.isin(part[0], bad),)]
            redone = self.merged([words[i] for i in bad.tolist()], single=True)
            ended.append((bad[redone[0]], redone[1], redone[2]))
        if not ended:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
        word, sym, at = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(word * int(sizes.max()) + at, kind="stable")
        return word[order], sym[order], at[order]

    def ids(self, words: list[str]):
        """The words' ids in one array, and where each word's begin and end in it."""
        import numpy as np

        word, sym, at = self.merged(words)
        sym = sym.astype(np.int64)
        lost = np.flatnonzero(sym < 0)
        if len(lost):  # characters outside the vocabulary, byte by byte
            spelt = [self.byte[list(words[w][p].encode())] for w, p in zip(word[lost].tolist(), at[lost].tolist(), strict=True)]
            count = np.ones(len(sym), np.int64)
            count[lost] = [len(x) for x in spelt]
            out = np.repeat(sym, count)
            out[out < 0] = np.concatenate(spelt)
            word, sym = np.repeat(word, count), out
        return sym, np.searchsorted(word, np.arange(len(words) + 1))

    def cut(self, text: str) -> list[str]:
        return re.findall("▁*[^▁\n]+|▁+|\n", "▁" + text.replace(" ", "▁")) if text else []

    def known(self, words: list[str]) -> dict[str, tuple[bytes, int, bytes]]:
        """Every word's ids as decimal text with commas behind, their number, and what they decode to."""
        import numpy as np

        if len(self.words) > CACHED:
            self.words.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids, cut = self.ids(part)
            csv, csv_cut = self.decimal.of(ids, cut)
            out, out_cut = self.surface.of(ids, cut)
            n, c, o = np.diff(cut).tolist(), csv_cut.tolist(), out_cut.tolist()
            for i, w in enumerate(part):
                self.words[w] = (csv[c[i] : c[i + 1]], n[i], out[o[i] : o[i + 1]])
        return self.words

    def encode(self, text: str | None) -> list[int]:
        return self.ids(self.cut(text or ""))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        import numpy as np

        return decoded(self.surface.of(np.array(ids, np.int64), np.array([0, len(ids)]))[0])


def decoded(data: bytes) -> str:
    """The library drops the space of the dummy prefix; bytes that are no UTF-8 become U+FFFD."""
    return data.removeprefix(b" ").decode("utf-8", "replace")


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _coded(path: str, key: str, text: str, with_ids: bool):
    def work(batches):
        import pyarrow as pa

        m = model(path)
        for batch in slices(batches, text, 1_000_000):
            cuts = [m.cut(x) if x else [] for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            known = m.known([w for c in cuts for w in c])
            n, ids_hash, text_hash, ids, texts = [], [], [], [], []
            for c in cuts:
                got = [known[w] for w in c]
                csv = b"".join([g[0] for g in got])[:-1]
                out = b"".join([g[2] for g in got]).removeprefix(b" ")
                n.append(sum([g[1] for g in got]))
                ids_hash.append(hashlib.sha256(csv).hexdigest())
                text_hash.append(hashlib.sha256(out).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in csv.split(b",")] if csv else [])
                    texts.append(decoded(b" " + out))
            cols = [batch.column(batch.schema.get_field_index(key)), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return work


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """-> key, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, the ids and the decoded text."""
    kind = docs.schema[key].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(key, text).mapInArrow(_coded(path, key, text, with_ids), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path(), with_ids=False)
