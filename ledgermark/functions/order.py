"""Positions and running totals over a whole table without one task that holds it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and the master is local.

    On a cluster each executor would write to a disk of its own, and later reads would
    miss those files without an error, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{tempfile.gettempdir()}/ledgermark-scratch"
    return path.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder that goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/ledgermark-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder, computed once and cut from its lineage."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positioned(df: DataFrame, order: list, totals: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``position`` (from 1) by ``order`` and, for each of ``totals``, its running sum.

    Rows are dealt out by range; what a partition needs of those before it is a row for
    each partition, a number that the cluster sets and the data does not.
    """
    totals = totals or {}
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    # written first, as dealing out by range reads its rows twice
    rows = checkpointed(df.select("*", *[t.alias(f"_v_{n}") for n, t in totals.items()]))
    rows = checkpointed(rows.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["_n", *[f"_s_{n}" for n in totals]]])
    here = Window.partitionBy("_part").orderBy(*cols)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, (F.row_number().over(here) + F.col("_n")).cast("long").alias("position"), *[(F.sum(f"_v_{n}").over(upto) + F.col(f"_s_{n}")).alias(n) for n in totals])
