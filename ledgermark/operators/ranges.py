"""References that name ranges of invoices (``INV1234-6`` is 1234 to 1236), joined without writing out the numbers.

A range is cut into aligned blocks of powers of two, at most two of each size, so one
that holds a million numbers is some forty rows. A number lies in one block of each size;
it probes the sizes that occur. Every number meets a range that holds it once, so the
result has no repeats to remove, and no range, however wide, is more than one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prefix, a number of up to 15 digits, and perhaps the last digits of a second one.
REFERENCE = r"\b{prefix}(\d{{1,15}})(?:-(\d{{1,15}}))?\b"


def references(text: Column, prefix: str = "INV") -> Column:
    """The ranges named in ``text``, an array of ``(lo, hi)``.

    The digits behind the hyphen stand for as many last digits of the first number
    (``INV1298-302`` ends at 1302), or for a whole number if they are as many or more.
    What would end before it begins is no range: only its first number counts. Null is no text.
    """
    pattern = F.lit(REFERENCE.format(prefix=prefix))
    first, last = (F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(i)) for i in (1, 2))

    def bounds(a: Column, b: Column) -> Column:
        lo = a.cast("long")
        keep = F.greatest(F.length(a) - F.length(b), F.lit(0))
        hi = F.when(b == "", lo).otherwise(F.concat(F.substr(a, F.lit(1), keep), b).cast("long"))
        return F.struct(lo.alias("lo"), F.greatest(lo, hi).alias("hi"))

    return F.zip_with(first, last, bounds)


def blocks(lo: Column, hi: Column, levels: int = 51) -> Column:
    """The aligned blocks that make up ``lo`` to ``hi``, both at least 0, as an array of ``(level, block)``; empty if ``lo`` > ``hi``."""
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    one = lambda cond, level, block: F.when(cond, F.array(F.struct(level.cast("int").alias("level"), block.alias("block")))).otherwise(none)

    def step(s, level):
        a, b = s["a"], s["b"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        # an odd end is a block of its own here; the rest is halved
        got = F.concat(s["got"], one(left, level, a), one(right, level, b - 1))
        return F.struct(F.shiftright(a + (a % 2), 1).alias("a"), F.shiftright(b, 1).alias("b"), got.alias("got"))

    start = F.struct(lo.cast("long").alias("a"), (hi.cast("long") + 1).alias("b"), none.alias("got"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step)["got"]


def in_ranges(ranges: DataFrame, points: DataFrame, point: str, on: list[str] | None = None) -> DataFrame:
    """Inner join of ``ranges(lo, hi, ...)`` with ``points``, whose number ``point`` lies in the range, and the columns ``on`` are equal.

    Numbers and ends below 0 or null meet nothing; repeated rows meet each.
    """
    on = on or []
    cut = ranges.withColumn("_b", F.explode(blocks(F.when(F.col("lo") >= 0, F.col("lo")), F.col("hi")))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    # sizes that occur: at most fifty numbers, one row
    levels = cut.agg(F.sort_array(F.collect_set("_level")).alias("_levels"))
    at = points.where(F.col(point) >= 0).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    at = at.withColumn("_block", F.expr(f"shiftright(cast(`{point}` AS bigint), _level)"))
    return cut.join(at, [*on, "_level", "_block"]).drop("_level", "_block")
