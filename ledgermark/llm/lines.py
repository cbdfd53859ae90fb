"""Line dedup by a segment-partition edit join; DataFrame functions only.

The first occurrence of a line stays (order: key, nulls last, then place); later
copies go, and so does a line within ``most`` edits of a line that occurs earlier.
Lines shorter than ``least_chars`` characters are left alone, unless ``short`` is set:
then later copies of every line go that is not blank, and the edit join takes lines from
``most`` + 1 characters on, the fewest that can be cut into segments.

Equal lines are grouped by two 64-bit hashes of different seeds. Each distinct line is
then cut into ``most`` + 1 segments, of which a line within ``most`` edits must hold one
unchanged: rows name a line's own segments by line length, number and hash, and in the
same way the substrings that may be a segment of a shorter line, at the places that
multi-match-aware selection leaves (Li, Deng, Wang and Feng, 2011). Lines that meet another
there, whose counts of a few letters allow it, go into a second such index that holds their
text; in it lines are verified by a banded bit-parallel automaton: for each number of errors
a word of 2 * most + 1 bits holds the diagonals reached. Both are semi joins, which stop at
the first match, so no pairs are made however many near copies a line has.

Documents are dealt out by key for three joins, one exchange that Spark reuses. Only hashes
travel for the first index. Which lines of a document are meant travels as bits, 64 in a
word, so that the work is linear in its lines.

Cases: null and empty texts are returned as they are; a document whose lines all go is
left with an empty text (``kept_lines`` 0); rows that share key and text count as one
document and fare alike, rows that share only the key are documents of their own; a
null key comes last; an empty table gives an empty result; extra columns stay, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import table, written

BREAK = "\n"


def boxed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k, h, box``: key, hash of the text, and the whole row, which pruning leaves alone.

    As every use carries the whole row, exchanges of these rows are equal and reused.
    """
    return docs.select(F.col(key).alias("k"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("h"), F.array(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("box"))


def marked(places: DataFrame) -> DataFrame:
    """``places(k, h, pos)`` -> ``mk, mh, bits``: for each document an array of words, bit pos % 64 of word pos / 64 set."""
    word = F.expr("pos div 64").cast("int")
    words = places.select("k", "h", word.alias("word"), F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("bit")).repartition("k", "h").groupBy("k", "h", "word").agg(F.bit_or("bit").alias("bit"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    dense = F.aggregate(F.sort_array(F.collect_list(F.struct("word", "bit"))), F.array().cast("array<bigint>"), lambda done, x: F.concat(done, zeros(x["word"] - F.size(done)), F.array(x["bit"])))
    return words.groupBy(F.col("k").alias("mk"), F.col("h").alias("mh")).agg(dense.alias("bits"))


def is_marked(bits: Column, pos: Column) -> Column:
    """Whether the bit of place ``pos`` is set; ``bits`` may be null."""
    word = F.get(bits, F.shiftright(pos, 6))
    return F.coalesce(F.call_function("shiftrightunsigned", word, pos.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))


def whole() -> Column:
    """The row in ``box``. The place is computed, as a literal one would let pruning take the row apart."""
    return F.get("box", F.pmod(F.col("h"), F.lit(1)).cast("int"))


def joined(rows: DataFrame, marks: DataFrame, how: str = "left") -> DataFrame:
    """Join of boxed rows with ``marks(mk, mh, ...)``, one row a document."""
    return rows.join(marks, F.col("k").eqNullSafe(F.col("mk")) & (F.col("h") == F.col("mh")), how)


def segment_names(lines: DataFrame, most: int) -> DataFrame:
    """``lines(line, n, ...)`` -> the same with ``segment`` and ``own``, a row for each substring that may be a segment.

    A line of n characters has ``most`` + 1 segments, the last ``n % (most + 1)`` of them
    longer by one; these rows are ``own``. The others are substrings that may be a
    segment of a line that is shorter by up to ``most``, at places that leave at most i
    errors on the left of segment i and ``most`` - i on its right. What differs between a
    line's rows is data (number, shortening, shift), so that generated code stays small
    enough to be compiled.
    """
    places = [(i, more, shift) for more in range(most + 1) for i in range(most + 1) for shift in range(max(-i, more - (most - i)), min(i, more + most - i) + 1)]
    place = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("i", "more", "shift"), p, strict=True)]) for p in places])).alias("_p")
    rows = lines.select("*", place).withColumn("_length", F.col("n") - F.col("_p.more")).where(F.col("_length") > most)
    short = F.lit(most + 1) - F.col("_length") % (most + 1)
    rows = rows.withColumn("_size", F.expr(f"_length div {most + 1}").cast("int") + (F.col("_p.i") >= short).cast("int"))
    start = F.col("_p.i") * F.expr(f"_length div {most + 1}").cast("int") + F.greatest(F.lit(0), F.col("_p.i") - short) + 1 + F.col("_p.shift")
    rows = rows.withColumn("_at", start).where((F.col("_at") >= 1) & (F.col("_at") + F.col("_size") - 1 <= F.col("n")))
    own = (F.col("_p.more") == 0) & (F.col("_p.shift") == 0)
    return rows.select(*lines.columns, F.xxhash64("_length", "_p.i", F.substring("line", F.col("_at"), F.col("_size"))).alias("segment"), own.cast("tinyint").alias("own"))


def within(a: Column, b: Column, most: int) -> Column:
    """Whether two arrays of characters are within ``most`` edits, by a banded bit-parallel automaton.

    Bit i + most of word e is set when, after j characters of ``b``, j + i of ``a``
    are reached with e errors.
    """
    mask = (1 << (2 * most + 1)) - 1

    def left(x):
        return F.shiftleft(x, 1).bitwiseAND(F.lit(mask))

    words = [F.lit(1 << most)]
    for _ in range(most):
        words.append(words[-1].bitwiseOR(left(words[-1])))

    def step(state, j):
        char = F.get(b, j)
        same = sum((F.coalesce(F.get(a, j + F.lit(i)) == char, F.lit(False)).cast("int") * (1 << (i + most)) for i in range(-most, most + 1)), F.lit(0))
        old = [state[f"e{e}"] for e in range(most + 1)]
        new = [old[0].bitwiseAND(same)]
        for e in range(1, most + 1):
            new.append(old[e].bitwiseAND(same).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)).bitwiseOR(left(new[-1])))
        return F.struct(*[w.alias(f"e{e}") for e, w in enumerate(new)])

    # equal beginnings add no edit; from the first difference on, most pairs die within
    # a few characters, and only the others are followed to the end
    begin = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
    ends = F.size(b) - 1

    def follow(state, first, last):
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, state, step)

    state = F.struct(*[w.alias(f"e{e}") for e, w in enumerate(words)])
    soon = F.least(begin + 8 * (most + 1), ends)
    apart = F.size(a) - F.size(b)
    done = F.aggregate(F.array(follow(state, begin, soon)), F.lit(False), lambda _, s: F.when(s[f"e{most}"] == 0, F.lit(False)).otherwise(_bit(follow(s, soon + 1, ends)[f"e{most}"], apart + most)))
    return F.when(F.abs(apart) > most, F.lit(False)).when(begin < 0, F.lit(True)).otherwise(done)


#: Counts of classes of characters are compared before two lines are. A class is one of these
#: letters with the digits and the Greek and Cyrillic letters dealt to it; other letters would
#: do as well. Latin capitals are in no class, as counting them costs more than it spares. The
#: first index has room for the first six classes, the second for all. Scripts with thousands
#: of characters need none, as their segments are rare.
LETTERS = "etnaoisrdlucmpg"
DEALT = "0123456789" + "".join(map(chr, [*range(0x391, 0x3CA), *range(0x400, 0x460)]))


def in_classes(line: Column, letters: str) -> Column:
    """A line whose digits and Greek and Cyrillic letters are replaced one by one by the letters of their classes."""
    to = "".join(letters[i % len(letters)] for i in range(len(DEALT)))
    return F.when(line.rlike("[0-9\u0391-\u03c9\u0400-\u045f]"), F.translate(line, DEALT, to)).otherwise(line)


def letter_counts(line: Column, letters: str) -> Column:
    """Four bits for each class of a line by :func:`in_classes`: its count, modulo 16."""
    # a class's letter is one byte, and a length in bytes is known without a look at the text
    size = F.octet_length
    counts = [F.shiftleft(((size(line) - size(F.replace(line, F.lit(c), F.lit("")))) % 16).cast("long"), 4 * i) for i, c in enumerate(letters)]
    return sum(counts[1:], counts[0])


def counts_apart(x: Column, y: Column, letters: str) -> Column:
    """A lower bound of twice the edits between two lines, from their letter counts."""

    def one(i):
        d = F.abs(F.shiftright(x, 4 * i).bitwiseAND(F.lit(15)) - F.shiftright(y, 4 * i).bitwiseAND(F.lit(15)))
        return F.least(d, 16 - d)

    return sum((one(i) for i in range(1, len(letters))), one(0))


def lines_within(a: Column, b: Column, most: int) -> Column:
    """:func:`within` for two lines that are not empty, whose characters are told apart once."""
    return F.aggregate(F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))), F.lit(False), lambda _, p: within(p["a"], p["b"], most))


def _bit(word: Column, place: Column) -> Column:
    return F.bit_get(word.cast("long"), F.least(F.greatest(place, F.lit(0)), F.lit(63))) == 1


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, most: int = 2, least_chars: int = 20, short: bool = False) -> DataFrame:
    """The rows of ``docs`` with what stays of their text, and ``n_lines``, ``kept_lines`` behind them (in ``_line_dedup``, in place of a column so named)."""
    docs = docs.drop("_line_dedup")
    if least_chars <= most:
        raise ValueError("least_chars must exceed the number of edits")
    taken = F.length("line") >= least_chars
    if short:
        taken = taken | F.col("line").rlike(r"\S")
    rows = boxed(docs, key, text)
    lines = F.split(whole()[text], BREAK)
    order = ["last", "k", "h", "pos"]
    seen = docs.select(F.col(key).isNull().alias("last"), F.col(key).alias("k"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("h"), F.posexplode(F.split(F.col(text), BREAK)).alias("pos", "line"))
    seen = written(seen.where(taken).select(*order, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), "lines-seen")
    first = written(seen.groupBy("h1", "h2").agg(F.min(F.struct(*order)).alias("first")), "lines-first")
    later = seen.join(first, ["h1", "h2"]).where(~F.struct(*order).eqNullSafe(F.col("first")))
    copies = written(marked(later), "lines-copies")

    # index and probe rows of the first occurrences
    here = joined(rows, copies).select("bits", F.posexplode(lines).alias("pos", "line"))
    here = here.where(taken & (F.length("line") > most) & ~is_marked(F.col("bits"), F.col("pos")))
    here = here.select("line", F.length("line").alias("n")).withColumn("id", F.xxhash64("line"))
    few = LETTERS[:6]
    here = here.withColumn("_c", in_classes(F.col("line"), few)).withColumn("counts", letter_counts(F.col("_c"), few)).drop("_c")
    # one long for 39 bits of the segment's hash, whether it is own, and the counts: at two
    # edits a line has twelve of these rows
    packed = F.shiftleft("segment", 25).bitwiseOR(F.shiftleft(F.col("own").cast("long"), 24)).bitwiseOR(F.col("counts"))
    parts = segment_names(here, most).select(packed.alias("packed"), "id")
    own = {x: F.shiftright(f"{x}.packed", 24).bitwiseAND(F.lit(1)) for x in "ab"}
    # one of the two must be the line's own segment; as the condition has both sides in
    # it, it stays in the join, whose sides are then one exchange
    same = F.shiftright("a.packed", 25) == F.shiftright("b.packed", 25)
    met = parts.alias("a").join(parts.alias("b"), same & (own["a"] + own["b"] > 0) & (F.col("a.id") != F.col("b.id")) & (counts_apart(F.col("a.packed"), F.col("b.packed"), few) <= 2 * most), "left_semi")

    # these lines, from the documents where they come first, and the second index
    places = first.join(met.select(F.col("id").alias("h1")).distinct(), "h1", "left_semi").select("first.*")
    asked = joined(rows, marked(places), "inner").select("k", "h", "bits", F.posexplode(lines).alias("pos", "line")).where(is_marked(F.col("bits"), F.col("pos")))
    asked = written(asked.select(F.struct(F.col("k").isNull().alias("last"), "k", "h", "pos").alias("at"), "line", F.length("line").alias("n")), "lines-asked")
    asked = asked.withColumn("_c", in_classes(F.col("line"), LETTERS)).withColumn("counts", letter_counts(F.col("_c"), LETTERS)).drop("_c")
    parts = segment_names(asked, most).drop("n")
    near = (F.col("a.segment") == F.col("b.segment")) & (F.col("a.own") + F.col("b.own") > 0) & (F.col("b.at") < F.col("a.at"))
    near = near & (counts_apart(F.col("a.counts"), F.col("b.counts"), LETTERS) <= 2 * most) & lines_within(F.col("a.line"), F.col("b.line"), most)
    near = written(marked(parts.alias("a").join(parts.alias("b"), near, "left_semi").select("at.*").distinct()), "lines-near")
    marks = copies.union(near).groupBy("mk", "mh").agg(F.collect_list("bits").alias("bits"))
    none = F.lit(0).cast("long")
    marks = marks.withColumn("bits", F.aggregate("bits", F.array().cast("array<bigint>"), lambda done, x: F.zip_with(done, x, lambda p, q: F.coalesce(p, none).bitwiseOR(F.coalesce(q, none)))))

    stays = F.when(F.col("bits").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~is_marked(F.col("bits"), i)))
    out = joined(rows, marks).select("h", "box", "bits", lines.alias("lines")).select("h", "box", "bits", "lines", stays.alias("stays"))
    kept = F.when(F.col("bits").isNull(), whole()[text]).otherwise(F.array_join("stays", BREAK))
    return out.select(*[(kept if c == text else whole()[c]).alias(c) for c in docs.columns], F.struct(F.greatest(F.size("lines"), F.lit(0)).alias("n_lines"), F.greatest(F.size("stays"), F.lit(0)).alias("kept_lines")).alias("_line_dedup"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return got.select("doc_id", F.col("_line_dedup.n_lines").alias("n_lines"), F.col("_line_dedup.kept_lines").alias("kept_lines"), F.length("text").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")
