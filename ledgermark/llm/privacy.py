"""PII surrogates: detected entities get keyed, type-consistent replacements.

A surrogate is drawn from an HMAC of the entity's type, normal form and a nonce, so one
entity gets one surrogate in every document (coreference), whatever its punctuation. It
keeps the format: letters stay letters of their script and case, digits digits, hexadecimal
stays hexadecimal, lengths, separators, issuer digits, country codes, top-level domains and
well-known prefixes stay, card numbers and account numbers keep right check digits, private
addresses stay private.

Names are found behind a title, and from then on wherever one of their parts stands in the
same document, with or without a title. Each part is an entity of its own, so a full name
and a bare surname agree, and a person has one name under several titles. They keep script,
case and gender: what most titles before a given name say, over all documents. A name that
never follows a title in its document is not found.

Card numbers count only with an issuer's first digits and a right check digit, account
numbers with theirs: others are some other number. Secrets are values behind ``password``,
``token`` and the like; letters alone count behind ``=``, in quotes, or with capitals.

Collision checks keep entities distinct: over the distinct entities of all documents, a
surrogate that equals an entity of its type, or that a smaller entity of its type has
too, is drawn again with the next nonce until none is left. Every second nonce adds a
letter or syllable to names, addresses and secrets, and takes private addresses from the
larger private block, so full shapes end; where a type of fixed size is full, the run fails
after :data:`ROUNDS` draws. Nonces above 0 and genders are broadcast while there are at most
``most_broadcast``, and joined by document beyond.

Cases: null texts stay null; a text without entities stays as it is; repeated rows give
repeated results; a null key is an ordinary key; an empty table gives an empty result;
extra columns stay, whatever their names. Texts are searched whole.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import slices, table, written
from ledgermark.llm.lines import boxed, joined, whole

#: The session's setting that holds the secret key, and the key of a query run without one.
KEY_SETTING, SHOWN_KEY = "spark.ledgermark.surrogate.key", "shown in the source, so it protects nothing"
#: Draws after which a type is taken to be full.
ROUNDS = 64

_TITLES = {"m": "Mr Herr Señor Monsieur Sr Don Sir Господин Κύριος", "f": "Mrs Ms Miss Frau Señora Señorita Madame Mme Mlle Sra Doña Госпожа Κυρία", "x": "Dr Prof Professor Доктор"}
TITLE = {t: g for g, ts in _TITLES.items() for t in ts.split()}
_NAME = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][\w'’-]+"
_T = rf"(?:{'|'.join(map(re.escape, TITLE))})\.? "
#: In order: what an earlier kind has taken, a later one leaves. Group 1 is the entity.
KINDS = (
    ("secret", re.compile(r"(?i)\b(?:token|password|passwd|secret|api[_-]?key)\b\s*([=:])\s*(?:\"([^\"\n]{8,})\"|'([^'\n]{8,})'|([^\s\"'<>,;]{8,}))")),
    ("awskey", re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b")),
    ("email", re.compile(r"([\w.+%-]+@[\w-]+(?:\.[\w-]+)+)")),
    ("ip", re.compile(r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d.]*\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])([0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:])")),
    ("iban", re.compile(r"\b([A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)\b")),
    ("card", re.compile(r"(?<![\d-])(\d{4}([ -]?)\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -]?)\d{6}\3\d{5})(?![\d-])")),
    ("ssn", re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])")),
    ("phone", re.compile(r"(?<![\w.])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])")),
    ("name", re.compile(rf"\b{_T}(?:{_T})*((?!{_T}){_NAME}(?: {_NAME}){{0,2}})")),
)
_DIGIT, _TITLED, _WORDS = re.compile(r"\d"), re.compile("|".join(map(re.escape, TITLE))), re.compile(r"\w+")
#: What a text must hold for a kind to be looked for.
_HINT = {"email": "@", "ipv6": ":"}


def _checked(kind: str, value: str) -> bool:
    """Whether what looks like a number of this kind is one."""
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return (digits[0] in "3456" or 2221 <= int(digits[:4]) <= 2720) and _luhn(digits) == 0
    if kind == "iban":
        return _mod97(value.replace(" ", "")) == 1
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return False
        return sum(map(bool, value.split(":"))) >= 2
    return True


def spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each entity, in order and apart."""
    digits, out, held = bool(_DIGIT.search(text)), [], None
    names: set[str] = set()

    def take(a, b, kind):
        nonlocal held
        held = held or bytearray(len(text))
        if held.find(1, a, b) < 0:
            held[a:b] = b"\1" * (b - a)
            out.append((a, b, kind))

    for kind, pattern in KINDS:
        if _HINT.get(kind, "") not in text or kind == "name" and not _TITLED.search(text) or kind in ("ip", "iban", "card", "ssn", "phone") and not digits:
            continue
        for m in pattern.finditer(text):
            if kind == "secret":
                which = next(i for i in (2, 3, 4) if m[i] is not None)
                a, b = m.span(which)
                b = a + len(text[a:b].rstrip(".)]}!?")) if which == 4 else b
                if b - a >= 8 and (not text[a:b].isalpha() or m[1] == "=" or which < 4 or text[a:b] != text[a:b].lower()):
                    take(a, b, kind)  # but not "password: something" in prose
            elif kind == "name":
                titles = [TITLE.get(t, "x") for t in _WORDS.findall(text[m.start() : m.start(1)])]
                names.update(m[1].split(" "))
                take(*m.span(1), "name-" + next((g for g in titles if g != "x"), "x"))
            elif _checked(kind, m[1]):
                take(*m.span(1), kind)
    if names:
        every = sorted({x for n in names for x in (n, n.upper())}, key=len, reverse=True)
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, every))})(?!\w)", text):
            take(*m.span(), "name-x")
    return sorted(out)


def entities(mention: str, kind: str) -> list[tuple[str, str, str]]:
    """The kind, normal form and told gender of what a mention is replaced by; a name has one for each part."""
    if kind.startswith("name"):
        parts = mention.split(" ")
        return [("name", p.casefold(), kind[-1] if i < len(parts) - 1 else "x") for i, p in enumerate(parts)]
    if kind in ("phone", "card", "ssn"):
        return [(kind, re.sub(r"\D", "", mention), "x")]
    if kind == "iban":
        return [(kind, mention.replace(" ", ""), "x")]
    return [(kind, mention.lower() if kind in ("email", "ipv6") else mention, "x")]


class Draw:
    """Whole numbers from an HMAC."""

    def __init__(self, key: bytes, kind: str, value: str, nonce: int):
        self.seed, self.round, self.rest = (key, f"{kind}|{nonce}|{value}".encode()), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 64:
            self.rest = int.from_bytes(hmac.new(self.seed[0], self.seed[1] + b"|%d" % self.round, hashlib.sha512).digest(), "big")
            self.round, self.left = self.round + 1, 512
        self.rest, got = divmod(self.rest, n)
        self.left -= n.bit_length()
        return got


def _mod97(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


#: Syllables of invented names: consonants and vowels, and endings by gender.
SCRIPTS = (
    (re.compile("[А-яЁё]"), "бвгдзклмнпрст", "аеиоу", {"m": "н", "f": "а", "x": "ь"}),
    (re.compile("[Α-ωά-ώ]"), "βγδκλμνπρστ", "αειο", {"m": "ς", "f": "α", "x": "ι"}),
    (re.compile(""), "bdfgklmnprstvz", "aeiou", {"m": "n", "f": "a", "x": "y"}),
)


@lru_cache(4096)
def _letters(c: str) -> str:
    """Letters of the script and case of ``c``, about as many as its neighbours are."""
    if c.isascii() or "À" <= c <= "ɏ":
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz"
    for alphabet in ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψως"):
        if c.lower() in alphabet:
            return alphabet[:-1].upper() if c.isupper() else alphabet[:-1]
    near = range(ord(c) & ~63, (ord(c) & ~63) + 64)
    return "".join(x for x in map(chr, near) if x.isalpha() and (x.isupper(), x.islower()) == (c.isupper(), c.islower()) and len(x.upper()) == len(x.lower()) == 1)


def surrogate(key: bytes, kind: str, value: str, nonce: int = 0, gender: str = "x") -> str:
    """The normal form that replaces a normal form."""
    draw, more = Draw(key, kind, value, nonce), nonce // 2
    if kind == "name":
        consonants, vowels, ends = next(x[1:] for x in SCRIPTS if x[0].search(value))
        out = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(max(3, len(value) // 2) + more))
        return out + (ends[gender] if gender in ends else "")
    if kind == "ip":
        octets = value.split(".")
        private = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] or octets[0] == "172" and 16 <= int(octets[1]) < 32 else 0
        octets, private = (["10"], 1) if private == 2 and more else (octets, private)
        first = [str(x) for x in range(11, 224) if x not in (127, 172, 192)]
        return ".".join(octets[:private] + [first[draw.below(len(first))] if i == 0 else str(1 + draw.below(254)) for i in range(private, 4)])
    if kind == "ipv6":
        groups = value.split(":")
        first = next(i for i, g in enumerate(groups) if g)
        return ":".join(g if i <= first else _hex(draw, g) for i, g in enumerate(groups))
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        return _shaped(draw, local + local[-1:] * more if local[-1:].isalpha() else local + "x" * more) + "@" + ".".join([_shaped(draw, x) for x in labels[:-1]] + labels[-1:])
    if kind == "secret":
        value += "x" * more
        return _hex(draw, value) if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and not value.isdigit() else _shaped(draw, value)
    keep = {"card": {"2": 4, "3": 2}.get(value[0], 1), "awskey": 4, "iban": 4, "phone": int(len(value) > 10)}.get(kind, 0)
    out = value[:keep] + _shaped(draw, value[keep:])
    if kind == "card":
        out = next(out[:-1] + d for d in "0123456789" if _luhn(out[:-1] + d) == 0)
    if kind == "iban":
        out = out[:2] + f"{98 - _mod97(out[:2] + '00' + out[4:]):02d}" + out[4:]
    return out


def _hex(draw: Draw, value: str) -> str:
    digits = "0123456789ABCDEF" if value != value.lower() else "0123456789abcdef"
    return "".join(digits[draw.below(16)] for _ in value)


def _shaped(draw: Draw, value: str) -> str:
    out = []
    for c in value:
        if c.isdecimal() and c.isascii():
            out.append("0123456789"[draw.below(10)] if c == "0" or out else "123456789"[draw.below(9)])
        elif c.isalpha():
            letters = _letters(c) or c
            out.append(letters[draw.below(len(letters))])
        else:
            out.append(c)
    return "".join(out)


def rendered(mention: str, kind: str, new: list[str]) -> str:
    """Normal forms put into the format of a mention."""
    if kind.startswith("name"):
        parts = mention.split(" ")
        return " ".join(n.upper() if p.isupper() and len(p) > 1 else n[:1].upper() + n[1:] for p, n in zip(parts, new, strict=True))
    if kind in ("phone", "card", "ssn"):
        digits = iter(new[0])
        return re.sub(r"\d", lambda _: next(digits), mention)
    if kind == "iban":
        chars = iter(new[0])
        return "".join(c if c == " " else next(chars) for c in mention)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new[0], strict=True)) if len(new[0]) == len(mention) else new[0]
    return new[0]


def replaced(text: str, key: bytes, odd: dict) -> tuple[str, int]:
    """The text with surrogates, and their number; ``odd`` has nonce and gender of the entities that are not at 0 and ``x``."""
    out, at, found = [], 0, spans(text)
    for a, b, kind in found:
        mention = text[a:b]
        new = [surrogate(key, k, v, *odd.get((k, v), (0, "x"))) for k, v, _ in entities(mention, kind)]
        out += [text[at:a], rendered(mention, kind, new)]
        at = b
    return "".join([*out, text[at:]]), len(found)


def _found(columns: list[str]):
    def work(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            row, got = [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                here = dict.fromkeys(e for a, b, kd in spans(text or "") for e in entities(text[a:b], kd))
                row += [i] * len(here)
                got += here
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(at) for c in columns] + [pa.array([e[j] for e in got], pa.string()) for j in range(3)], names=[*columns, "kind", "value", "gender"])

    return work


def nonces(found: DataFrame, key: bytes, name: str = "pii", draw=surrogate, rounds: int = ROUNDS) -> DataFrame:
    """``found(kind, value, gender)`` of all documents -> ``kind, value, gender, nonce`` of the entities whose nonce isn't 0 or whose gender is told."""
    spark = found.sparkSession

    def drawn(batches):
        for pdf in batches:
            pdf["new"] = [draw(key, *r) for r in zip(pdf["kind"], pdf["value"], pdf["nonce"], pdf["gender"], strict=True)]
            yield pdf[["kind", "value", "gender", "nonce", "new"]]

    schema = "kind string, value string, gender string, nonce long, new string"
    told = F.count_if(F.col("gender") == "m") - F.count_if(F.col("gender") == "f")
    real = written(found.groupBy("kind", "value").agg(F.when(told > 0, "m").when(told < 0, "f").otherwise("x").alias("gender")), name)
    fixed = spark.createDataFrame([], schema)
    todo = real.withColumn("nonce", F.lit(0).cast("long"))
    for _ in range(rounds):
        new = written(todo.mapInPandas(drawn, schema), name)
        # taken: an entity's own text, an earlier surrogate, or that of a smaller entity
        taken = real.select("kind", F.col("value").alias("new")).union(fixed.select("kind", "new"))
        least = new.groupBy("kind", "new").agg(F.min("value").alias("least"))
        free = new.join(taken.distinct(), ["kind", "new"], "left_anti").join(least, ["kind", "new"]).where(F.col("value") == F.col("least")).drop("least")
        free = written(free.select(new.columns), name)
        rest = new.join(free.select("kind", "value"), ["kind", "value"], "left_anti")
        todo = written(rest.select("kind", "value", "gender", (F.col("nonce") + 1).alias("nonce")), name)
        fixed = fixed.union(free)
        if todo.isEmpty():
            return fixed.where("nonce > 0 or gender <> 'x'").select("kind", "value", "gender", "nonce")
    left = todo.groupBy("kind").count().collect()
    raise RuntimeError(f"no distinct surrogates are left for {', '.join(f'{r[1]} of kind {r[0]}' for r in left)}")


def pseudonymized(docs: DataFrame, key: str = "doc_id", text: str = "text", *, secret: bytes, most_broadcast: int = 100_000) -> DataFrame:
    """The rows of ``docs`` with surrogates in their text, and the number of replacements in ``_entities`` (in place of a column so named)."""
    if not secret:
        raise ValueError("surrogates need a secret key")
    docs = docs.drop("_entities")
    spark = docs.sparkSession
    rows = boxed(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("h"), F.col(text).alias("text"))
    found = written(found.mapInArrow(_found(["k", "h"]), f"k {kind}, h long, kind string, value string, gender string"), "pii-found")
    odd = written(nonces(found, secret), "pii-nonces")
    schema = "k {0}, h long, text string, nonces array<struct<kind string, value string, gender string, nonce bigint>>".format(kind)
    if odd.count() <= most_broadcast:
        shared = spark.sparkContext.broadcast({(r.kind, r.value): (r.nonce, r.gender) for r in odd.collect()})
        ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.lit(None).cast(schema.split("nonces ")[1]).alias("nonces"))
    else:
        marks = found.drop("gender").join(odd, ["kind", "value"]).groupBy(F.col("k").alias("mk"), F.col("h").alias("mh")).agg(F.collect_set(F.struct("kind", "value", "gender", "nonce")).alias("nonces"))
        shared = spark.sparkContext.broadcast({})
        ready = joined(rows, marks).select(whole().alias("row"), whole()[text].alias("text"), "nonces")

    def work(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            texts, counts = [], []
            for x, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                odd = {(o["kind"], o["value"]): (o["nonce"], o["gender"]) for o in own} if own else shared.value
                new, n = replaced(x, secret, odd) if x is not None else (None, 0)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["row", "text", "n"])

    row = ready.schema["row"].dataType.simpleString()
    out = ready.mapInArrow(work, f"row {row}, text string, n long")
    return out.select(*[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns], F.col("n").alias("_entities"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = spark.conf.get(KEY_SETTING, SHOWN_KEY).encode()
    got = pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), secret=secret)
    return got.select("doc_id", F.col("_entities").alias("n_entities"), "text")
