"""Causes of a residual, ranked by how well each predicts it, and sentences about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions.money import major_text

#: Causes in order, and their sentences.
TEMPLATES = {
    "BANK_CHARGE": "Gap of {gap} against {amount} matches this counterparty's usual deduction.",
    "ROUNDING": "Gap of {gap} is within rounding tolerance for {lines} line(s).",
    "FX_DIFFERENCE": "Gap of {gap} against {amount} is consistent with a rate difference.",
    "PARTIAL_PAYMENT": "Gap of {gap} equals one outstanding line; the payment appears partial.",
    "UNEXPLAINED": "Gap of {gap} against {amount} does not fit any known cause. Needs review.",
}


def causes(residual: Column, amount: Column, lines: Column, fee_bps: int) -> Column:
    """Array of (cause, fit), best first, ties in the order of causes; empty without residual."""
    seen, size = F.abs(residual), F.abs(amount)
    guesses = [F.floor(size * fee_bps / 10_000).cast("long"), F.greatest(lines, F.lit(1)).cast("long"), F.floor(size / 100).cast("long"), size]
    fits = [1.0 / (1.0 + F.abs(seen - g) / F.greatest(F.least(seen, g), F.lit(1))) for g in guesses] + [F.lit(0.05)]
    rows = F.array(*[F.struct((-fit).alias("worse"), F.lit(i).alias("place"), F.lit(c).alias("cause")) for i, (c, fit) in enumerate(zip(TEMPLATES, fits, strict=True))])
    ranked = F.transform(F.array_sort(rows), lambda r: F.struct(r["cause"].alias("cause"), (-r["worse"]).alias("fit")))
    return F.when(residual == 0, F.filter(ranked, lambda r: F.lit(False))).otherwise(ranked)


def sentence(cause: Column, residual: Column, amount: Column, lines: Column) -> Column:
    out = None
    for name, text in TEMPLATES.items():
        filled = F.lit(text)
        for hole, value in (("{gap}", major_text(residual)), ("{amount}", major_text(amount)), ("{lines}", lines.cast("string"))):
            filled = F.replace(filled, F.lit(hole), value)
        out = F.when(cause == name, filled) if out is None else out.when(cause == name, filled)
    return out


def situation(cause: Column, residual: Column, lines: Column) -> Column:
    """A short name of a situation, under which sentences are written once."""
    return F.substring(F.sha1(F.concat_ws("|", cause, residual.cast("string"), lines.cast("string"))), 1, 12)


def figures_allowed(text: Column, allowed: Column) -> Column:
    """Whether every figure in a text equals one of ``allowed`` (decimals) by value, sign aside."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(38,6)"))
    return F.forall(found, lambda x: F.exists(allowed, lambda a: F.abs(a.cast("decimal(38,6)")) == x))
