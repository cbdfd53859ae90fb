"""Patterns of corrections: sets of attribute values that recur, and the rules they propose.

Two passes of counting: values that are frequent by themselves, then pairs of frequent
values of the same correction. A pair can't be more frequent than its parts, so nothing
that is frequent is missed. Both are grouped counts with partial sums; a correction gives
at most a row for each pair of its attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed


def frequent(corrections: DataFrame, attributes: list[str], impact: str, support: int = 10) -> DataFrame:
    """``pattern, size, n, impact`` of values and pairs of values that at least ``support`` corrections have.

    A pattern is ``attribute=value``, two of them joined by `` & `` in order of ``attributes``;
    null is no value. Repeated rows are corrections of their own.
    """
    items = F.filter(F.array(*[F.when(F.col(a).isNotNull(), F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"{a}="), F.col(a).cast("string")).alias("v"))) for i, a in enumerate(attributes)]), lambda x: x.isNotNull())
    rows = checkpointed(corrections.select(F.monotonically_increasing_id().alias("_id"), F.col(impact).alias("_impact"), items.alias("_items")))
    each = rows.select("_id", "_impact", F.explode("_items").alias("_x"))
    ones = checkpointed(each.groupBy("_x").agg(F.count("*").alias("n"), F.sum("_impact").alias("impact")).where(F.col("n") >= support))
    left = each.join(ones.select("_x"), "_x").groupBy("_id").agg(F.first("_impact").alias("_impact"), F.sort_array(F.collect_list("_x")).alias("_x"))
    pairs = F.flatten(F.transform("_x", lambda a: F.transform(F.filter("_x", lambda b: b["i"] > a["i"]), lambda b: F.concat(a["v"], F.lit(" & "), b["v"]))))
    twos = left.select("_impact", F.explode(pairs).alias("pattern")).groupBy("pattern").agg(F.lit(2).alias("size"), F.count("*").alias("n"), F.sum("_impact").alias("impact")).where(F.col("n") >= support)
    return ones.select(F.col("_x.v").alias("pattern"), F.lit(1).alias("size"), "n", "impact").union(twos.select("pattern", "size", "n", "impact"))


def proposed(patterns: DataFrame, outcome: str) -> DataFrame:
    """Rules of the form other value -> value of ``outcome``: ``condition, outcome, n, impact, confidence``, the share of corrections with the condition that have the outcome."""
    parts = F.split("pattern", " & ")
    said = F.filter(parts, lambda p: p.startswith(f"{outcome}="))
    twos = patterns.where("size = 2").where(F.size(said) == 1).select(F.filter(parts, lambda p: ~p.startswith(f"{outcome}="))[0].alias("condition"), said[0].alias("outcome"), "n", "impact")
    ones = patterns.where("size = 1").select(F.col("pattern").alias("condition"), F.col("n").alias("_n"))
    return twos.join(ones, "condition").select("condition", "outcome", "n", "impact", F.round(F.col("n") / F.col("_n"), 6).alias("confidence"))
