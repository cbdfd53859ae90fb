"""Corrections: which stage failed, cases kept from them, and a simulated learning loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed, positioned
from ledgermark.operators.cases import retain, retrieve  # noqa: F401  cases kept from corrections, and found again

LOCI = ("none", "multiplicity", "blocking", "ranking", "threshold", "unattributed")


def locus(correct_keys: Column, candidates: Column, ranked_keys: Column, posted: Column, routed_multiple: Column, truly_multiple: Column) -> Column:
    """The stage that a correction points at; null candidates are unknown, an empty array is a miss."""
    missing = candidates.isNotNull() & (F.size(F.array_except(correct_keys, candidates)) > 0)
    some = F.coalesce(F.size(ranked_keys) > 0, F.lit(False))
    return (
        F.when(routed_multiple & truly_multiple, "none")
        .when(routed_multiple != truly_multiple, "multiplicity")
        .when(missing, "blocking")
        .when(some & ~F.array_contains(correct_keys, F.get(ranked_keys, F.lit(0))), "ranking")
        .when(some & ~posted, "threshold")
        .when(~some & candidates.isNull(), "unattributed")
        .otherwise("none")
    )


def reviewed_keys(keys: Column) -> Column:
    """A reviewer's keys without blanks and repeats, in order."""
    return F.filter(F.array_distinct(F.transform(keys, F.trim)), lambda k: k != "")


def rank_of(correct_keys: Column, ranked_keys: Column) -> Column:
    """Position of the first correct key in the ranking, null if outside."""
    return F.array_min(F.filter(F.transform(correct_keys, lambda k: F.array_position(ranked_keys, k)), lambda p: p > 0))


def outcomes(applied: DataFrame, least_applied: int = 3, least_right: float = 0.9) -> DataFrame:
    """``applied(case_id, correct)`` -> applications, accuracy and whether the case retires."""
    by = applied.groupBy("case_id").agg(F.count("*").alias("applications"), F.sum(F.col("correct").cast("int")).alias("n_correct"))
    return by.select("case_id", "applications", F.round(F.col("n_correct") / F.col("applications"), 6).alias("accuracy"), ((F.col("applications") >= least_applied) & (F.col("n_correct") / F.col("applications") < least_right)).alias("retired"))


def wrong_keys(labels: DataFrame, keys: DataFrame, seed: int = 7) -> DataFrame:
    """Placebo corrections: for each ``(record_id, label)`` another key, by a seeded hash over the keys' positions; none if there is but one."""
    pool = positioned(keys.select("key").distinct(), ["key"])
    n = pool.count()
    at = labels.join(pool.withColumnRenamed("key", "label").withColumnRenamed("position", "own"), "label")
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", "record_id", F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    step = F.pmod(drawn, F.lit(max(n - 1, 1))) + 1
    at = at.withColumn("position", F.pmod(F.col("own") - 1 + step, F.lit(n)) + 1)
    return at.join(pool, "position").where(F.col("key") != F.col("label")).select("record_id", "label", F.col("key").alias("wrong_key"))


def simulate(decisions: DataFrame, truth: DataFrame, *, batch_size: int = 500, spot_check: float = 0.25, arm: str = "corrections", seed: int = 7) -> DataFrame:
    """Batches in arrival order; feedback from each raises what later ones know.

    A key confirmed by feedback is preferred from the next batch on for records of its
    account and amount. Arms: ``off`` gives no feedback, ``corrections`` that of queued
    records, ``spot_check`` also a share of the posted ones, ``placebo`` confirms keys of
    other records, never the right one, in both cases, ``shuffled`` what the batch's next
    record was told. Returns per batch: decided, posted, wrong, corrected, and the shares
    that were posted (autonomy) and rightly so (precision).
    """
    return simulated(arrivals(decisions, truth, batch_size), spot_check=spot_check, arm=arm, seed=seed)


def arrivals(decisions: DataFrame, truth: DataFrame, batch_size: int = 500) -> DataFrame:
    """Decisions with their labels and batches, written once for however many arms."""
    at = decisions.join(truth, "record_id").select("record_id", "account", "amount_minor", "outcome", "key", "label")
    return checkpointed(positioned(at, ["record_id"]).withColumn("batch", F.floor((F.col("position") - 1) / batch_size)).drop("position"))


def simulated(at: DataFrame, *, spot_check: float = 0.25, arm: str = "corrections", seed: int = 7) -> DataFrame:
    """:func:`simulate` on :func:`arrivals`."""
    if arm not in ("off", "corrections", "spot_check", "placebo", "shuffled"):
        raise ValueError(f"unknown arm {arm}")
    share = F.pmod(F.xxhash64("record_id", F.lit(seed)), F.lit(1000)) / 1000
    seen = F.col("outcome") == "queued"
    if arm in ("spot_check", "placebo", "shuffled"):
        seen = seen | ((F.col("outcome") == "posted") & (share < spot_check))
    if arm == "placebo":
        at = at.join(wrong_keys(at.select("record_id", "label"), at.select(F.col("label").alias("key")), seed).select("record_id", "wrong_key"), "record_id", "left")
    told = {"corrections": F.col("label"), "spot_check": F.col("label"), "placebo": F.col("wrong_key") if arm == "placebo" else None, "shuffled": F.lead("label").over(Window.partitionBy("batch").orderBy("record_id"))}.get(arm, F.lit(None))
    told = at.withColumn("told", told).where(seen & F.col("told").isNotNull()).select("account", "amount_minor", "batch", "told")
    known = told.groupBy("account", "amount_minor", "batch").agg(F.min("told").alias("told")).withColumnRenamed("batch", "known_from")
    use = at.join(known, ["account", "amount_minor"], "left").withColumn("told", F.when(F.col("known_from") < F.col("batch"), F.col("told")))
    use = use.groupBy("record_id", "batch", "outcome", "key", "label").agg(F.max_by("told", "known_from").alias("told"))
    final = F.coalesce("told", "key")
    posted = (F.col("outcome") == "posted") | F.col("told").isNotNull()
    by = use.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.count_if(posted).alias("posted"), F.count_if(posted & (final != F.col("label"))).alias("wrong"), F.count_if(F.col("outcome") == "queued").alias("corrected"))
    return by.withColumn("autonomy", F.round(F.col("posted") / F.col("n"), 6)).withColumn("precision", F.round(1 - F.try_divide("wrong", "posted"), 6))
