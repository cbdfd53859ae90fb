"""Ranking of candidates within a record, by rules or by any score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rules_best(pair_rows: DataFrame) -> DataFrame:
    """The best key by (amount missed, day gap, key): ``record_id, key, amount_missed, gap``."""
    rows = pair_rows.select("record_id", F.struct((1 - F.col("amount_exact")).cast("int").alias("amount_missed"), F.col("date_gap_abs").cast("int").alias("gap"), "key").alias("s"))
    return rows.groupBy("record_id").agg(F.min("s").alias("s")).select("record_id", "s.key", "s.amount_missed", "s.gap")


def rules_score(pair_rows: DataFrame) -> DataFrame:
    """``record_id, key, score`` by closeness of amount and day. Not a probability, nor comparable to a model's score."""
    return pair_rows.select("record_id", "key", closeness().alias("score"))


def closeness() -> Column:
    """The rules' score of a pair; null where its amounts are unknown."""
    return 4.0 / (1.0 + F.col("amount_delta_abs")) + 1.0 / (1.0 + F.col("date_gap_abs"))


def ranked(scored: DataFrame) -> DataFrame:
    """``record_id, n, key, score, margin, ranked_keys``: by score, ties by key; no margin with one candidate."""
    rows = scored.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), F.col("key").alias("key")))).alias("r"))
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    return rows.select("record_id", F.size("r").cast("long").alias("n"), first["key"].alias("key"), (-first["worse"]).alias("score"), (second["worse"] - first["worse"]).alias("margin"), F.transform("r", lambda x: x["key"]).alias("ranked_keys"))


def best_two(scored: DataFrame, *more) -> DataFrame:
    """As :func:`ranked`, but gathers a record's keys only if ``ranked_keys`` is read; ``more`` are aggregates of the pairs.

    A pair without a score, as of a key that nothing is known about, is no candidate here.
    """
    order = Window.partitionBy("record_id").orderBy(F.col("score").desc_nulls_last(), "key")
    at = scored.withColumn("_r", F.row_number().over(order))
    known = F.col("score").isNotNull()
    first, second = (F.max(F.when((F.col("_r") == k) & known, F.col("score"))) for k in (1, 2))
    keys = F.transform(F.sort_array(F.collect_list(F.when(known, F.struct("_r", "key")))), lambda x: x["key"])
    return at.groupBy("record_id").agg(F.count("score").alias("n"), F.max(F.when((F.col("_r") == 1) & known, F.col("key"))).alias("key"), first.alias("score"), (first - second).alias("margin"), keys.alias("ranked_keys"), *more)


def with_ranks(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("score").desc(), "key")))


def training_pairs(pair_rows: DataFrame, negatives: int = 24, seed: int = 7) -> DataFrame:
    """Pairs of single-key records whose key is a candidate: the right one and up to ``negatives`` others, by a seeded hash."""
    right = (F.col("key") == F.col("label")).cast("int")
    rows = pair_rows.where("not is_mult").withColumn("is_label", right).withColumn("has", F.max("is_label").over(Window.partitionBy("record_id"))).where("has = 1")
    order = Window.partitionBy("record_id").orderBy(F.col("is_label").desc(), F.md5(F.concat_ws("|", "record_id", "key", F.lit(str(seed)))), "key")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= negatives + 1).drop("r", "has")
