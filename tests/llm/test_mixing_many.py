"""Mixes of very many sources, and of rows that are all alike."""

import time

from pyspark.sql import functions as F

from ledgermark.llm import mixing


def check(df, seconds_of=None):
    start = time.time()
    got = mixing.mix(df)
    got = got.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("size").alias("most"), F.first("target").alias("target"), F.max("copies").alias("copies")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["most"] + 1e-6 and r["copies"] <= 2 for r in got)
    return sum(r["n"] for r in got), len(got), time.time() - start


def table(spark, n, sources):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % sources).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"))


def test_many_sources_cost_little_more_than_few(spark):
    check(table(spark, 1000, 3))
    rows, sources, few = check(table(spark, 60_000, 3))
    assert (rows, sources) == (60_000, 3)
    rows, sources, many = check(table(spark, 60_000, 6_000))
    assert (rows, sources) == (60_000, 6_000)
    print("seconds", round(few, 1), round(many, 1))


def test_equal_rows_without_a_key_share_no_leaf(spark):
    df = table(spark, 100_000, 1).select(F.lit(None).cast("long").alias("doc_id"), "source", F.lit("one two three").alias("text"))
    rows, _, _ = check(df.union(table(spark, 500, 2)))
    assert rows == 100_500
    sizes = mixing.repeated(df.limit(0).groupBy("source").count().union(spark.createDataFrame([("a", 150_000), ("b", 1)], "source string, count long")), "count", "nth").groupBy("source").agg(F.count("*"), F.count_distinct("nth"), F.max("nth")).collect()
    assert {tuple(r) for r in sizes} == {("a", 150_000, 150_000, 149_999), ("b", 1, 1, 0)}


def test_large_keys_beside_null_ones_stay_exact(spark):
    keys = [2**62 + i for i in range(40)] + [None] * 3
    df = spark.createDataFrame([(k, "a", "x y z") for k in keys], "doc_id long, source string, text string")
    assert sorted((r["key"] for r in mixing.mix(df).collect()), key=str) == sorted(keys, key=str)
