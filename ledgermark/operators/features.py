"""Statistics of keys, features of (record, key) pairs and of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed

#: The order is a contract with trained models.
PAIR = ("amount_exact", "amount_delta_abs", "amount_delta_rel", "total_delta_abs", "total_delta_rel", "date_gap_abs", "date_gap_signed", "date_missing", "key_n_rows", "key_is_single_row", "key_total_major", "n_candidates")
MULT = ("has_exact", "n_candidates", "log_amount", "amount_over_median", "mult_rate", "min_delta", "min_delta_rel")
NO_GAP, NO_DELTA = 999.0, 1e12
#: Into how many ranges values are counted at once.
RANGES = 4096


def key_stats(ledger: DataFrame) -> DataFrame:
    """``key, amounts (distinct), days (distinct), n_rows, total_minor``, over all accounts; equal amounts count once in the total."""
    # dealt out first: sets of parts are larger than their rows, and hardly two rows of a task share a key
    rows = ledger.select("key", "amount_minor", "day").repartition("key")
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("amount_minor")).alias("amounts"), F.sort_array(F.collect_set("day")).alias("days"), F.count("*").alias("n_rows")).withColumn("total_minor", F.aggregate("amounts", F.lit(0).cast("long"), lambda s, x: s + x))


def brief(bank: DataFrame) -> DataFrame:
    """``bank`` with a digest of 16 bytes for ``record_id``, which is kept as ``name``: pairs travel with the digest."""
    return bank.withColumn("name", F.col("record_id")).withColumn("record_id", F.unhex(F.md5("name")))


def numbered(bank: DataFrame) -> DataFrame:
    """As :func:`brief` with a number in place of the digest, equal ids having one number; written, as numbers are new each time."""
    rows = bank.repartition("record_id").withColumn("_at", F.monotonically_increasing_id())
    number = F.min("_at").over(Window.partitionBy("record_id"))
    named = rows.withColumn("name", F.col("record_id")).withColumn("_at", number).withColumn("record_id", F.when(F.col("name").isNotNull(), F.col("_at")))
    return checkpointed(named.drop("_at"))


def pairs(cand: DataFrame, bank: DataFrame, stats: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Candidates with their record and key statistics, features included.

    Keys without statistics drop out, or stay with null features if ``keep_unknown``.
    ``cand`` may bring the record's ``amount_minor`` and ``day`` and then may repeat a pair.
    Pairs go to their keys with these two alone and to their records with what follows from
    the statistics; the record's other columns meet them there.
    """
    if "day" not in cand.columns:
        cand = cand.join(bank.select("record_id", "amount_minor", "day").distinct(), "record_id")
    amount, day = F.col("amount_minor"), F.col("day")
    near = F.array_min(F.transform("days", lambda d: F.struct(F.abs(day - d).alias("gap"), d.alias("d"))))
    miss = F.array_min(F.transform("amounts", lambda a: F.struct(F.abs(a - amount).alias("miss"), a.alias("a"))))
    at = cand.select("record_id", "key", "amount_minor", "day").join(stats, "key", "left" if keep_unknown else "inner")
    at = at.select("record_id", "key", "n_rows", "total_minor", miss.alias("_miss"), F.size("days").alias("_n_days"), near.alias("_near"))
    at = at.select("record_id", "key", "n_rows", "total_minor", F.col("_miss.miss").alias("miss"), F.col("_miss.a").alias("near_amount"), "_n_days", F.col("_near.gap").alias("gap"), F.col("_near.d").alias("near_day"))
    at = at.repartition("record_id").dropDuplicates(["record_id", "key"])
    n = F.count("n_rows").over(Window.partitionBy("record_id"))
    at = at.withColumn("n", n).join(bank, "record_id")
    has_day = day.isNotNull() & (F.col("_n_days") > 0)
    scale = F.greatest(F.abs(amount), F.lit(1)) / 100
    delta, total = F.col("miss") / 100, F.abs(amount - F.col("total_minor")) / 100
    cols = {
        "amount_exact": F.when(F.col("n_rows").isNotNull() & amount.isNotNull(), F.coalesce(F.col("miss") == 0, F.lit(False))).cast("double"),
        "amount_delta_abs": delta,
        "amount_delta_rel": F.least(delta / scale, F.lit(1e6)),
        "total_delta_abs": total,
        "total_delta_rel": F.least(total / scale, F.lit(1e6)),
        "date_gap_abs": F.when(has_day, F.col("gap").cast("double")).otherwise(NO_GAP),
        "date_gap_signed": F.when(has_day, (day - F.col("near_day")).cast("double")).otherwise(0.0),
        "date_missing": (~has_day).cast("double"),
        "key_n_rows": F.col("n_rows").cast("double"),
        "key_is_single_row": (F.col("n_rows") == 1).cast("double"),
        "key_total_major": F.col("total_minor") / 100,
        "n_candidates": F.col("n").cast("double"),
    }
    return at.select("*", *[c.alias(name) for name, c in cols.items()])


def account_prior(train: DataFrame) -> tuple[DataFrame, float, float]:
    """``account, median_abs, mult_rate`` of training records, and the two over all of them; a median of 0 counts as 1."""
    rows = train.select("account", F.abs("amount_minor").alias("a"), F.col("is_mult").cast("int").alias("m"))
    rate, middle = rows.agg(F.avg("m")).first()[0], median(rows.select("a"))
    by = rows.where("account is not null").groupBy("account").agg(F.percentile("a", 0.5).alias("median_abs"), F.avg("m").alias("mult_rate"))
    return by, float(middle or 1.0) or 1.0, float(rate or 0.0)


def median(rows: DataFrame) -> float | None:
    """The exact median of a column of whole numbers, from counts of ever narrower ranges: no task holds all values."""
    c = F.col(rows.columns[0])
    lo, hi, n = rows.agg(F.min(c), F.max(c), F.count(c)).first()
    if not n:
        return None

    def nth(k: int, lo: int, hi: int) -> int:
        while lo < hi:
            width = -(-(hi - lo + 1) // RANGES)
            found = rows.where(c.between(lo, hi)).groupBy(F.expr(f"({rows.columns[0]} - {lo}L) div {width}L").alias("at")).count().collect()
            for at, many in sorted(map(tuple, found)):
                if k <= many:
                    lo, hi = lo + at * width, min(hi, lo + (at + 1) * width - 1)
                    break
                k -= many
        return lo

    low = nth((n + 1) // 2, lo, hi)
    return float(low) if n % 2 else (low + nth(n // 2 + 1, lo, hi)) / 2


def mult_features(bank: DataFrame, pair_rows: DataFrame, prior: tuple[DataFrame, float, float], keep: tuple = ()) -> DataFrame:
    """``record_id`` and the features of :data:`MULT`, for every record, with the bank's columns ``keep`` behind them."""
    by, median, rate = prior
    agg = pair_rows.groupBy("record_id").agg(F.count("*").alias("n"), F.max("amount_exact").alias("exact"), F.min("miss").alias("miss"))
    at = bank.join(agg, "record_id", "left").join(by, "account", "left")
    size = F.abs("amount_minor").cast("double")
    middle = F.coalesce(F.when(F.col("median_abs") != 0, F.col("median_abs")), F.when(F.col("median_abs") == 0, F.lit(1.0)), F.lit(median))
    delta = F.coalesce(F.col("miss").cast("double"), F.lit(NO_DELTA))
    return at.select(
        "record_id", F.coalesce("exact", F.lit(0.0)).alias("has_exact"), F.coalesce("n", F.lit(0)).cast("double").alias("n_candidates"),
        F.log10(size + 1).alias("log_amount"), (size / middle).alias("amount_over_median"), F.coalesce("mult_rate", F.lit(rate)).alias("mult_rate"),
        F.least(delta / 100, F.lit(NO_DELTA)).alias("min_delta"), F.least(delta / F.greatest(size, F.lit(1.0)), F.lit(1e6)).alias("min_delta_rel"), *keep,
    )
