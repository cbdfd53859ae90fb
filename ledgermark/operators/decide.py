"""One decision for each bank record, as one plan.

The order of the cases is the meaning: nothing blocked, nothing scorable, suspected
grouped, ranked, direct, no support. ``n_blocked`` and ``n_scored`` are both given.
A record that cannot be scored (its margin or confidence is no number) is queued as
``model_error``, and without any ranker every record is queued as ``no_ranker``; a batch
goes on in both cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.gate import Policy, gate, threshold
from ledgermark.operators import blocking, features, rank

DIRECT = 0.9898
GROUPED_AT = 0.7


def decisions(bank: DataFrame, cand: DataFrame, pair_rows: DataFrame, ranked: DataFrame, *, p_multiple: DataFrame | None = None, calibrate=None, policy: Policy = Policy(), grouped_at: float = GROUPED_AT) -> DataFrame:
    """``ranked`` as made by :func:`rank.ranked`; ``p_multiple(record_id, p_multiple)``, by default 1 without an exact amount.

    ``calibrate`` maps a margin column to a probability; without it the sigmoid is used
    and the confidence is labelled as not validated.
    """
    blocked = cand.groupBy("record_id").agg(F.count("*").alias("n_blocked"))
    exact = pair_rows.groupBy("record_id").agg(F.sum("amount_exact").cast("long").alias("n_exact"))
    at = bank.join(blocked, "record_id", "left").join(exact, "record_id", "left").join(ranked, "record_id", "left")
    if p_multiple is not None:
        at = at.join(p_multiple, "record_id", "left")
    else:
        at = at.withColumn("p_multiple", F.when(F.coalesce("n_exact", F.lit(0)) > 0, 0.0).otherwise(1.0))
    return decided(at, calibrate, policy, grouped_at)


def looked_up(records: DataFrame, ledger: DataFrame, stats: DataFrame, slack: int = 7) -> DataFrame:
    """What :func:`decided` needs of each record, from one pass over the pairs; ``records`` as made by :func:`features.brief` or :func:`features.numbered`.

    ``best_amount`` and ``best_rows`` are the best key's nearest amount, the lower of two, and its number of rows.
    With labels, ``hit`` is whether the right key is a candidate, and null without any.
    """
    found = blocking.found(records, ledger, slack, ("amount_minor", "day"))
    p = features.pairs(found, records, stats, keep_unknown=True).withColumn("score", rank.closeness())
    hit = [F.max(F.col("key") == F.col("label")).alias("hit")] if "label" in records.columns else []
    best = [F.max(F.when((F.col("_r") == 1) & F.col("score").isNotNull(), F.col(c))).alias(name) for c, name in (("near_amount", "best_amount"), ("n_rows", "best_rows"))]
    by = rank.best_two(p, F.count("*").alias("n_blocked"), F.sum("amount_exact").cast("long").alias("n_exact"), *best, *hit).drop("score")
    at = records.join(by, "record_id", "left").withColumn("record_id", F.col("name")).drop("name")
    return at.withColumn("p_multiple", F.when(F.coalesce("n_exact", F.lit(0)) > 0, 0.0).otherwise(1.0))


def decided(at: DataFrame, calibrate=None, policy: Policy = Policy(), grouped_at: float = GROUPED_AT, keep: tuple = ()) -> DataFrame:
    """Rows with ``n_blocked, n_exact, n, key, margin, ranked_keys, p_multiple`` -> decisions, with the columns ``keep`` behind them."""
    n_blocked, n_scored, n_exact = (F.coalesce(c, F.lit(0)) for c in ("n_blocked", "n", "n_exact"))
    grouped = (F.col("p_multiple") >= grouped_at) & (n_exact != 1)
    path = F.when(n_blocked == 0, "blocked").when(n_scored == 0, "unscorable").when(grouped, "multiplicity").when(n_scored >= 2, "ranked").when(n_exact == 1, "direct").otherwise("lone")
    at = at.withColumn("path", path)
    sure = calibrate(F.col("margin")) if calibrate else 1 / (1 + F.exp(-F.col("margin")))
    broken = F.coalesce(F.isnan(sure.cast("double")), F.lit(True)) | F.isnan(F.coalesce(F.col("margin"), F.lit(float("nan"))).cast("double"))
    at = at.withColumn("path", F.when((F.col("path") == "ranked") & broken, "model_error").otherwise(F.col("path")))
    at = at.withColumn("confidence", F.when(F.col("path") == "ranked", sure).when(F.col("path") == "direct", F.lit(DIRECT)))
    absent = F.when(F.col("path") == "blocked", "no_candidates").when(F.col("path") == "unscorable", "unscorable").when(F.col("path") == "multiplicity", "grouped").when(F.col("path") == "model_error", "model_error").otherwise("no_support")
    at = at.withColumn("absent", F.when(F.col("confidence").isNull(), absent)).withColumn("gate", gate(F.col("confidence"), F.col("amount_minor"), F.col("absent"), policy))
    outcome = F.when(F.col("path") == "blocked", "no_candidate").when(F.col("path") == "unscorable", "unscorable").when(F.col("path") == "multiplicity", "suspected_grouped").when(F.col("gate") == "post", "posted").otherwise("queued")
    chosen = F.when(F.col("path").isin("ranked", "direct", "lone"), F.col("key"))
    source = F.when(F.col("path") == "ranked", "calibrated" if calibrate else "rules_unvalidated").when(F.col("path") == "direct", "direct_unvalidated")
    return at.select(
        "record_id", "account", "amount_minor", "day", outcome.alias("outcome"), F.when(F.col("path") == "lone", "ranked").otherwise(F.col("path")).alias("path"), "absent", "gate", "confidence", source.alias("confidence_source"),
        threshold(F.col("amount_minor"), policy).alias("threshold"), chosen.alias("key"), F.when(F.col("path") == "ranked", F.col("margin")).alias("margin"), n_blocked.alias("n_blocked"), n_scored.alias("n_scored"), n_exact.alias("n_exact"), (n_exact == 1).alias("lone_exact"),
        F.when(F.col("path").isin("ranked", "direct", "lone"), F.col("ranked_keys")).alias("ranked_keys"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    ).withColumn("explanation", explanation()).withColumnsRenamed({f"_keep_{i}": c for i, c in enumerate(keep)})


def without_ranker(bank: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Every record queued, with the columns of :func:`decisions`: what is left to do when no ranker can be loaded."""
    at = bank.select("record_id", "account", "amount_minor", "day", *[F.lit(0).cast("long").alias(c) for c in ("n_blocked", "n", "n_exact")], F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("margin"), F.lit(None).cast("array<string>").alias("ranked_keys"), F.lit(0.0).alias("p_multiple"))
    out = decided(at, policy=policy)
    said = {"outcome": "queued", "path": "no_ranker", "absent": "no_ranker", "explanation": "No ranker was there to score this record; it needs a review."}
    return out.withColumns({c: F.lit(x) for c, x in said.items()}).withColumn("gate", gate(F.col("confidence"), F.col("amount_minor"), F.col("absent"), policy))


def explanation() -> Column:
    """A sentence for a reviewer."""
    key, need = F.col("key"), F.round(F.col("threshold") * 100, 1)
    sure = F.round(F.col("confidence") * 100, 1)
    return (
        F.when(F.col("outcome") == "no_candidate", "No ledger entry of this account has this amount or a day near it.")
        .when(F.col("outcome") == "unscorable", "Ledger entries were found, but nothing is known about their keys.")
        .when(F.col("outcome") == "suspected_grouped", "No single entry explains this amount; it may cover several keys.")
        .when(F.col("path") == "model_error", "This record could not be scored; it needs a review.")
        .when(F.col("confidence").isNull(), F.concat(key, F.lit(" is the only entry near, and its amount differs; nothing supports it.")))
        .when(F.col("outcome") == "posted", F.concat(F.lit("Posted to "), key, F.lit(" at "), sure, F.lit(" %, above the required "), need, F.lit(" %.")))
        .otherwise(F.concat(F.lit("Best entry is "), key, F.lit(" at "), sure, F.lit(" %, below the required "), need, F.lit(" %.")))
    )
