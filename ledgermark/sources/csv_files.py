"""Bank and ledger uploads: delimited text whose columns, dates and decimals are found out.

Everything is read as text; money becomes whole minor units and is refused, never
rounded, when it doesn't fit. Rows whose amount or date cannot be used are returned with
their number and a reason; a file without a header, rows, or a column for account, amount
or date is refused as a whole. Rows are numbered from 2 on, the header being 1 and rows
without any text left out; files of a folder follow each other by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.functions.dates import LAYOUTS, parse_day
from ledgermark.functions.money import strict_minor, upload_minor
from ledgermark.functions.order import positioned

DELIMITERS = (",", ";", "\t", "|")
REQUIRED = ("account", "amount", "date")
#: What headers of a field look like, the likeliest first.
HEADERS = {
    "amount": (r"^amount$", r"\bamt\b", r"amount", r"\bvalue\b(?!.*date)", r"\bcredit\b", r"\bdebit\b", r"\btotal\b"),
    "date": (r"^date$", r"value\s*date", r"\bdt\b", r"date", r"^day$", r"\bposted\b", r"\bbook(ed|ing)\b"),
    "account": (r"^account$", r"\ba/?c\b", r"account", r"\bacct\b", r"\biban\b", r"\bcounterparty\b", r"\bcustomer\b"),
    "key": (r"^key$", r"\bkey\b", r"reference", r"\bref\b", r"invoice", r"allocation", r"\bid\b"),
}


def delimiter(header: str) -> str:
    """The one that gives the most fields; ties go to the first."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def columns(headers: list[str], backend: Callable[[list[str]], dict] | None = None) -> dict[str, str]:
    """Field -> header. ``backend`` may name headers of fields that no pattern finds; wrong answers and failures count as none."""
    found: dict[str, str] = {}
    for field, patterns in HEADERS.items():
        for p in patterns:
            hit = next((h for h in headers if re.search(p, h.strip().lower()) and h not in found.values()), None)
            if hit is not None:
                found[field] = hit
                break
    if backend is not None and len(found) < len(HEADERS):
        try:
            said = backend(headers)
        except Exception:  # noqa: BLE001  any failure of a helper outside leaves what was found
            said = {}
        for field, h in (said or {}).items():
            if field in HEADERS and field not in found and h in headers:
                found[field] = h
    return found


def date_layout(rows: DataFrame, column: str) -> str | None:
    """The layout that most rows of the whole file fit; ties go to the first in the list."""
    counts = rows.agg(*[F.count(parse_day(F.col(f"`{column}`"), p)).alias(str(i)) for i, p in enumerate(LAYOUTS)]).first()
    best = max(range(len(LAYOUTS)), key=lambda i: (counts[i], -i))
    return LAYOUTS[best] if counts[best] else None


def text_rows(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """All-text rows with ``_row``, their number, and the delimiter.

    A file is read in parts, unless a line with an unpaired quote shows that values
    hold line breaks.
    """
    lines = spark.read.text(path)
    first = lines.first()
    header = (first["value"] if first else "").removeprefix("\ufeff")
    if not header.strip():
        raise ValueError("the file has no header")
    sep = delimiter(header)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = not lines.where(quotes % 2 == 1).isEmpty()
    df = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("encoding", "UTF-8").option("escape", '"').option("multiLine", broken).csv(path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line")]
    df = df.select(*[F.col(f"`{c}`").alias(c.removeprefix("\ufeff")) for c in df.columns], *place)
    names = df.columns[:-3]
    df = df.where(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in names]) != "")
    rows = positioned(df, ["_file", "_start", "_line"])
    return rows.select(*[F.col(f"`{c}`") for c in names], (F.col("position") + 1).alias("_row")), sep


def _parsed(spark: SparkSession, path: str, name: str, backend) -> tuple[DataFrame, DataFrame, str | None]:
    rows, sep = text_rows(spark, path)
    headers = [c for c in rows.columns if c != "_row"]
    found = columns(headers, backend)
    missing = [f for f in REQUIRED if f not in found]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}; the file has {', '.join(headers)}")
    if rows.isEmpty():
        raise ValueError("the file has no rows below its header")
    layout = date_layout(rows, found["date"])
    text = lambda field: F.nullif(F.trim(F.col(f"`{found[field]}`")), F.lit(""))
    minor = upload_minor(F.col(f"`{found['amount']}`"), "," if sep == ";" else ".")
    day = parse_day(text("date"), layout) if layout else F.lit(None).cast("int")
    place = F.concat(F.lit("row-"), F.col("_row"))
    own = F.coalesce(text("key"), place) if "key" in found else place
    error = F.when(text("amount").isNull(), "blank amount").when(minor.isNull(), "unreadable amount").when(text("date").isNull(), "blank date").when(day.isNull(), "unreadable date")
    at = rows.select("_row", own.alias(name), text("account").alias("account"), minor.alias("amount_minor"), day.alias("day"), error.alias("error"))
    return at.where("error is null").drop("error", "_row"), at.where("error is not null").select("_row", name, "error"), layout


def read_bank(spark: SparkSession, path: str, backend=None) -> tuple[DataFrame, DataFrame, str | None]:
    """Usable records under their own ids (``row-N`` where they have none), refused rows with their reason, and the date layout."""
    return _parsed(spark, path, "record_id", backend)


def read_ledger(spark: SparkSession, path: str, backend=None) -> tuple[DataFrame, DataFrame, str | None]:
    """As :func:`read_bank`, with a ``key`` for each row."""
    return _parsed(spark, path, "key", backend)


def wide_frame(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One wide all-text frame, ledger side ``A_*`` and bank side ``B_*`` -> ledger, bank and quarantined rows.

    A ledger row needs amount and allocation key; a bank record an amount, its account
    falling back from B to A, a blank target meaning several keys. Bad money or dates
    quarantine the row, or raise when ``strict``.
    """
    at = rows.withColumn("_row", F.monotonically_increasing_id())
    bad = F.lit(False)
    for side in "AB":
        at = at.withColumn(f"_{side}m", strict_minor(F.col(f"{side}_amount"))).withColumn(f"_{side}d", parse_day(F.col(f"{side}_valueDate"), "M/d/yy"))
        for raw, got in ((f"{side}_amount", f"_{side}m"), (f"{side}_valueDate", f"_{side}d")):
            bad = bad | ((F.trim(F.coalesce(raw, F.lit(""))) != "") & F.col(got).isNull())
    at = at.withColumn("_bad", F.when(bad, F.raise_error(F.lit("unreadable amount or date")).cast("boolean")).otherwise(False) if strict else bad)
    good = at.where("not _bad")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    ledger = good.where(F.col("_Am").isNotNull() & blank("generatorAllocation").isNotNull()).select(blank("generatorAllocation").alias("key"), blank("A_account").alias("account"), F.col("_Am").alias("amount_minor"), F.col("_Ad").alias("day"))
    target = blank("targetAllocation")
    bank = good.where("_Bm is not null").select(F.concat(F.lit("b"), "_row").alias("record_id"), F.coalesce(blank("B_account"), blank("A_account")).alias("account"), F.col("_Bm").alias("amount_minor"), F.col("_Bd").alias("day"), F.coalesce(target, F.lit("MULT")).alias("label"), target.isNull().alias("is_mult"), F.col("matchId").alias("match_id"))
    return ledger, bank, at.where("_bad").drop("_bad")
