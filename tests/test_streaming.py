from pyspark.sql import functions as F

from ledgermark.operators import learn
from ledgermark.streaming import feed
from tests.conftest import DATA


def stream(spark, df, path, parts=3, per_batch=1):
    df.coalesce(1).write.option("maxRecordsPerFile", -(-df.count() // parts)).parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(str(path))


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_cases_streamed_equal_cases_in_batch(spark, tmp_path):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(120)
    twice = vectors.union(vectors.withColumn("vec_id", F.col("vec_id") + 10_000))
    arrivals = twice.select(F.col("vec_id").alias("seq"), F.concat(F.lit("c"), "vec_id").alias("case_id"), F.col("label").cast("string").alias("locus"), F.col("embedding").cast("array<double>").alias("situation")).orderBy("seq")
    got = run(spark, feed.retain_feed(stream(spark, arrivals, tmp_path / "in")), tmp_path, "retained")
    counts = {(r["locus"], r["case_id"]): r["count"] for r in got.where("event = 'confirmed'").groupBy("locus", "case_id").count().collect()}
    streamed = sorted((r["locus"], r["case_id"], counts.get((r["locus"], r["case_id"]), 0)) for r in got.where("event = 'kept'").collect())
    assert streamed == sorted(map(tuple, learn.retain(arrivals).collect())) and sum(counts.values()) >= 120


def test_band_join_of_streams_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("lt"), F.col("event_id").alias("l"))
    b = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("rt"), F.col("event_id").alias("r"))
    days = 2
    batch = a.join(b, "user_id").where(f"rt BETWEEN lt - INTERVAL {days} DAYS AND lt + INTERVAL {days} DAYS").count()
    joined = feed.near_in_time(stream(spark, a, tmp_path / "a", 1), stream(spark, b, tmp_path / "b", 1), "user_id", days, "40 days")
    assert batch > 0 and run(spark, joined, tmp_path, "near").count() == batch


def test_situations_once(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("situation"))
    got = run(spark, feed.distinct_situations(stream(spark, e, tmp_path / "s", 1), "60 days"), tmp_path, "once")
    assert got.count() == e.select("situation").distinct().count()


def test_outer_band_join_and_late_rows(spark, tmp_path):
    day = lambda d: F.expr(f"timestamp'2024-01-01' + INTERVAL {d} DAYS")

    def put(name, column, rows):
        """A file for each batch of (key, day, id)."""
        for batch in rows:
            df = None
            for k, d, i in batch:
                one = spark.range(1).select(F.lit(k).alias("k"), day(d).alias(column), F.lit(i).alias(name))
                df = one if df is None else df.union(one)
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    a = put("l", "lt", [[("x", 1, 1), ("y", 1, 2), ("x", 30, 3)], [("x", 200, 4)], [("y", 2, 5), ("x", 400, 6)], [("x", 600, 7)]])
    b = put("r", "rt", [[("x", 3, 1), ("y", 20, 2), ("x", 31, 3)], [("x", 200, 4)], [("x", 400, 5)], [("x", 600, 6)]])
    joined = feed.near_in_time(a, b, "k", 7, "10 days", "left")
    q = joined.writeStream.format("memory").queryName("outer").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["l"], r["r"]) for r in spark.table("outer").collect()}
    # the purchase of day 2 came when the watermark was past day 190: it is dropped and counted
    assert got == {(1, 1), (2, None), (3, 3), (4, 4), (6, 5), (7, 6)} and feed.late_rows(q) == 1
