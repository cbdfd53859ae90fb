"""Money text to integer minor units; never through a float, never rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _minor(whole: Column, negative: Column) -> Column:
    """Minor units of text like ``1234.5``; null where it is anything else."""
    ok = whole.rlike(r"^(\d+(\.\d{0,2})?|\.\d{1,2})$")
    units = F.regexp_extract(whole, r"^(\d*)", 1)
    cents = F.rpad(F.regexp_extract(whole, r"\.(\d{0,2})$", 1), 2, "0")
    value = F.try_to_number(F.concat(F.lpad(units, 17, "0"), cents), F.lit("9" * 19))
    value = value.cast("bigint")
    return F.when(ok, F.when(negative, -value).otherwise(value))


def upload_minor(raw: Column, decimal: str = ".") -> Column:
    """Minor units of an amount in an uploaded file.

    Spaces go; a currency sign in front and text behind go; parentheses or a minus in
    front make it negative; more than two decimals are refused. A trailing minus
    negates (rather than being lost). Null where blank or unreadable.
    """
    x = F.regexp_replace(raw, r"[\s ]", "")
    x = F.translate(F.replace(x, F.lit("."), F.lit("")), ",", ".") if decimal == "," else F.replace(x, F.lit(","), F.lit(""))
    paren = x.rlike(r"^\(.*\)$")
    x = F.when(paren, F.regexp_extract(x, r"^\((.*)\)$", 1)).otherwise(x)
    x = F.regexp_replace(x, r"^[^0-9+.\-]+", "")
    trailing = x.rlike(r"^[^-].*\d-$")
    x = F.regexp_replace(x, r"[^0-9]+$", "")
    negative = paren | x.startswith("-") | trailing
    return _minor(F.regexp_replace(x, r"^[+-]", ""), negative)


def strict_minor(raw: Column) -> Column:
    """Minor units of plain figures: thousands commas and a leading minus, nothing else."""
    x = F.replace(F.trim(raw), F.lit(","), F.lit(""))
    return _minor(F.regexp_replace(x, "^-", ""), x.startswith("-"))


def money_error(raw: Column, value: Column) -> Column:
    """``blank`` or ``unreadable`` where there is no value."""
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "blank").when(value.isNull(), "unreadable")


def major_text(minor: Column) -> Column:
    """Two decimals and thousands separators."""
    return F.format_number((minor / 100).cast("decimal(38,2)"), 2)
