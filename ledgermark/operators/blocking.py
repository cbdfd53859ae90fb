"""Candidate keys of bank records: exact amount, or a ledger day within some days.

bank: record_id, account, amount_minor, day. ledger: key, account, amount_minor, day.
Null accounts match nothing; null days only by amount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_amount(bank: DataFrame, ledger: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``more`` are further columns of the bank to keep; the ledger is dealt out once, repeated rows going where they meet."""
    right = ledger.select("key", "account", "amount_minor").repartition("account", "amount_minor").distinct()
    return bank.select("record_id", "account", "amount_minor", *[c for c in more if c != "amount_minor"]).join(right, ["account", "amount_minor"]).select("record_id", "key", *more)


def by_day(bank: DataFrame, ledger: DataFrame, slack: int, more: tuple[str, ...] = ()) -> DataFrame:
    """A band join as an equi-join: days fall into bins as wide as the band, so a record probes two at most."""
    wide = 2 * slack + 1
    bin_of = lambda d: F.floor(d / F.lit(wide)).cast("int")
    left = bank.where("day is not null").select("record_id", "account", F.col("day").alias("d"), *[F.col(c).alias(f"_{c}") for c in more], F.explode(F.array_distinct(F.array(bin_of(F.col("day") - slack), bin_of(F.col("day") + slack)))).alias("bin"))
    right = ledger.where("day is not null").select("key", "account", "day", bin_of(F.col("day")).alias("bin")).repartition("account", "bin").distinct()
    return left.join(right, ["account", "bin"]).where(F.col("day").between(F.col("d") - slack, F.col("d") + slack)).select("record_id", "key", *[F.col(f"_{c}").alias(c) for c in more])


def found(bank: DataFrame, ledger: DataFrame, slack: int = 7, more: tuple[str, ...] = ()) -> DataFrame:
    """``record_id, key`` and ``more`` of the record, by amount and by day; a pair that is found twice is there twice."""
    return by_amount(bank, ledger, more).union(by_day(bank, ledger, slack, more))


def candidates(bank: DataFrame, ledger: DataFrame, slack: int = 7, use_amount: bool = True, use_date: bool = True) -> DataFrame:
    """-> distinct ``(record_id, key)``, dealt out by record."""
    if slack < 0:
        raise ValueError("slack must not be negative")
    if not (use_amount or use_date):
        raise ValueError("amount or date must be used")
    parts = [by_amount(bank, ledger)] if use_amount else []
    parts += [by_day(bank, ledger, slack)] if use_date else []
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.repartition("record_id").distinct()


def unmatched(bank: DataFrame, cand: DataFrame) -> DataFrame:
    return bank.join(cand, "record_id", "left_anti")


def sweep(bank: DataFrame, ledger: DataFrame, slacks=(0, 1, 2, 3, 7, 14)) -> DataFrame:
    """Recall of single-key records and mean candidates for amount only and for each slack, from one band join.

    A pair is a candidate of every strategy whose slack its day gap is within.
    """
    gap = by_gap(bank, ledger, max(slacks))
    n = bank.where("not is_mult").select(F.count("*").alias("n_single"))
    aggs = []
    for s in (-1, *slacks):
        on = F.col("gap") <= s
        aggs += [F.count_if(on & (F.col("key") == F.col("label")) & ~F.col("is_mult")).alias(f"hits_{s}"), F.count_if(on).alias(f"pairs_{s}")]
    one = gap.join(bank.select("record_id", "label", "is_mult"), "record_id").agg(*aggs).crossJoin(n)  # one row each
    rows = F.array(*[F.struct(F.lit("amount" if s < 0 else f"date_{s}").alias("strategy"), F.col(f"hits_{s}").alias("hits"), F.col(f"pairs_{s}").alias("pairs")) for s in (-1, *slacks)])
    return one.select("n_single", F.explode(rows).alias("r")).select("r.strategy", "r.pairs", "r.hits", F.round(F.col("r.hits") / F.col("n_single"), 6).alias("recall"))


def by_gap(bank: DataFrame, ledger: DataFrame, slack: int) -> DataFrame:
    """``(record_id, key, gap)``: the smallest slack at which a pair is a candidate, -1 by amount."""
    amount = by_amount(bank, ledger).withColumn("gap", F.lit(-1))
    wide = 2 * slack + 1
    left = bank.where("day is not null").select("record_id", "account", F.col("day").alias("d"), F.explode(F.array_distinct(F.array(F.floor((F.col("day") - slack) / wide).cast("int"), F.floor((F.col("day") + slack) / wide).cast("int")))).alias("bin"))
    right = ledger.where("day is not null").select("key", "account", "day", F.floor(F.col("day") / wide).cast("int").alias("bin")).distinct()
    days = left.join(right, ["account", "bin"]).select("record_id", "key", F.abs(F.col("day") - F.col("d")).alias("gap")).where(F.col("gap") <= slack)
    return amount.union(days).groupBy("record_id", "key").agg(F.min("gap").alias("gap"))
