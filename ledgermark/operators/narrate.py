"""Sentences for residuals: each situation is written once, by a supplied writer or by template."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.residual import TEMPLATES, sentence, situation

_FIGURE = re.compile(r"[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?")


def json_part(text: str):
    """The first JSON array or object in a text, fenced or not; None if there is none."""
    for opening in ("[", "{"):
        at = text.find(opening)
        while at >= 0:
            try:
                return json.JSONDecoder().raw_decode(text[at:])[0]
            except ValueError:
                at = text.find(opening, at + 1)
    return None


def figures_ok(text: str, allowed: list) -> bool:
    """Whether every figure of a text is one of ``allowed`` by value, sign aside."""
    values = {abs(Decimal(str(a))) for a in allowed}
    try:
        return all(Decimal(x.replace(",", "")) in values for x in _FIGURE.findall(text))
    except InvalidOperation:
        return False


def narrated(rows: DataFrame, writer: Callable[[str], str] | None = None, batch: int = 20) -> DataFrame:
    """``rows(record_id, cause, residual, amount, n_rows)`` -> ``record_id, cause, sentence, source``.

    ``writer`` gets a JSON list of items and answers with a JSON list of
    ``{"situation", "cause", "sentence"}``. What it gets wrong (no JSON, another cause,
    a figure that the item doesn't have, an exception) falls back to the template. One
    item of each situation goes to it, in batches, on the workers.
    """
    named = rows.withColumn("situation", situation(F.col("cause"), F.col("residual"), F.col("n_rows")))
    plain = sentence(F.col("cause"), F.col("residual"), F.col("amount"), F.col("n_rows"))
    if writer is None:
        return named.select("record_id", "cause", plain.alias("sentence"), F.lit("template").alias("source"))
    items = named.groupBy("situation").agg(F.min(F.struct("cause", "residual", "amount", "n_rows")).alias("i")).select("situation", "i.*")

    def write(batches):
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                todo = pdf.iloc[at : at + batch]
                try:
                    said = json_part(writer(todo.to_json(orient="records"))) or []
                    by = {x["situation"]: x for x in said if x.get("cause") in TEMPLATES}
                except Exception:  # noqa: BLE001  a writer's failure must not fail the run
                    by = {}
                good = []
                for r in todo.itertuples():
                    x = by.get(r.situation)
                    allowed = [r.residual, r.amount, r.n_rows, Decimal(int(r.residual)) / 100, Decimal(int(r.amount)) / 100]
                    if x and isinstance(x.get("sentence"), str) and figures_ok(x["sentence"], allowed):
                        good.append((r.situation, x["cause"], x["sentence"]))
                yield pd.DataFrame(good, columns=["situation", "w_cause", "w_sentence"])

    written = items.mapInPandas(write, "situation string, w_cause string, w_sentence string")
    both = named.join(written, "situation", "left")
    return both.select("record_id", F.coalesce("w_cause", "cause").alias("cause"), F.coalesce("w_sentence", plain).alias("sentence"), F.when(F.col("w_sentence").isNotNull(), "writer").otherwise("template").alias("source"))
