"""Date text to whole days since 2000-01-01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The layouts an upload may use, in order of preference.
LAYOUTS = (
    "yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d/M/yy",
    "M/d/yy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "d.M.yyyy", "yyyyMMdd",
)


def day_of(date: Column) -> Column:
    return F.datediff(date, F.lit("2000-01-01").cast("date"))


def parse_day(raw: Column, layout: str) -> Column:
    """Days of ``raw`` in a layout, null where it does not fit; two-digit years from 69 on are of the last century."""
    x = F.replace(F.trim(raw), F.lit(","), F.lit(""))
    date = F.try_to_timestamp(x, F.lit(layout)).cast("date")
    if "yy" in layout and "yyyy" not in layout:
        date = F.when(F.year(date) > 2068, F.add_months(date, -1200)).otherwise(date)
    return F.when(x != "", day_of(date))
