"""Pieces that several operators share: scratch tables, Arrow slices, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.functions.order import shared_dir

#: What the operators call a word: a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage.

    The session's folder goes when its JVM ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/ledgermark-{spark.sparkContext.applicationId}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, column: str, most: int = 2_000_000):
    """Arrow batches cut so that ``column``'s bytes stay near ``most``; one long row stays whole."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            kind = np.int64
        else:
            kind = np.int32
        ends = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def flat_bytes(col):
    """The bytes of a string or binary column as one uint8 array, and its n+1 offsets; null is empty."""
    import numpy as np
    import pyarrow as pa

    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the least node's name.

    Alternating large-star and small-star contraction (Kiveris et al., 2014): each
    step is a partial minimum per node and a join, so a hub's neighbours are never
    gathered in one row. Steps are written tables; the minima are written before the
    join, so that both its sides are shuffled and a hub's partition can be split.
    Self loops and nulls are ignored; no edges give no rows.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.union(pairs.select(F.col("b"), F.col("a"))).toDF("u", "v")
        else:
            near = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = written(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        moved = near.join(least, "u")
        if large:
            out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return written(out.where("a <> b").distinct(), name)

    pairs = written(edges.select("a", "b").where("a <> b").distinct(), name)
    state = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == state:
            break
        state = tuple(now)
        pairs = stars(stars(pairs, True), False)
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
