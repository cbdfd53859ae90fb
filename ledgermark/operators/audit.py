"""An append-only trail of decisions, runs and corrections as Parquet.

Only appending is offered; that is a convention of this module, weaker than a
database's trigger, since files can be deleted by other means.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermark.functions.order import positioned

RUN = "run_id string, event string, at timestamp, approver string, reason string, blocking string, gate string, policy_version string, notes string"


COLUMNS = ("seq", "record_id", "decided_at", "path", "outcome", "key", "keys", "confidence", "threshold", "amount_minor", "n_candidates", "reason", "policy_version", "evidence", "reviewer", "kind")


def entries(decisions: DataFrame, policy_version: str = "1") -> DataFrame:
    """Rows of the trail, but for time and run: numbered from 1 by record."""
    reason = F.col("explanation") if "explanation" in decisions.columns else F.lit("")
    rows = positioned(decisions, ["record_id"]).withColumnRenamed("position", "seq")
    return rows.select(
        "seq", "record_id", "path", "outcome", "key", F.when(F.col("key").isNotNull(), F.array("key")).otherwise(F.array().cast("array<string>")).alias("keys"), "confidence", "threshold", "amount_minor",
        F.col("n_blocked").cast("long").alias("n_candidates"), reason.alias("reason"), F.lit(policy_version).alias("policy_version"), F.to_json(F.struct("ranked_keys", "margin", "n_blocked", "n_scored")).alias("evidence"),
        F.lit(None).cast("string").alias("reviewer"), F.lit("decision").alias("kind"),
    )


class Trail:
    """Tables ``runs`` and ``decisions`` below a folder that any Hadoop file system holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _event(self, run_id: str, event: str, approver: str | None = None, reason: str | None = None, settings: tuple = (None,) * 4) -> None:
        row = self.spark.createDataFrame([(run_id, event, None, approver, reason, *settings)], RUN).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def start_run(self, approver: str, *, blocking: dict | None = None, gate: dict | None = None, policy_version: str = "1", notes: str = "") -> str:
        """Starts a run under settings that someone approved, which are kept with it."""
        if not approver.strip():
            raise ValueError("a run needs an approver")
        run_id = uuid.uuid4().hex
        self._event(run_id, "running", approver, settings=(json.dumps(blocking or {}, sort_keys=True), json.dumps(gate or {}, sort_keys=True), policy_version, notes))
        return run_id

    def status(self, run_id: str) -> str | None:
        if not self._there("runs"):
            return None
        row = self.runs().where(F.col("run_id") == run_id).first()
        return row and row["status"]

    def finish_run(self, run_id: str) -> None:
        self._need(run_id)
        self._event(run_id, "completed")

    def fail_run(self, run_id: str, reason: str) -> None:
        self._need(run_id)
        self._event(run_id, "failed", reason=reason)

    def _need(self, run_id: str) -> None:
        if self.status(run_id) != "running":
            raise ValueError(f"run {run_id} is not running")

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def runs(self) -> DataFrame:
        """Each run with the status of its latest event and its settings; a completed or failed run stays so."""
        events = self.spark.read.schema(RUN).parquet(f"{self.path}/runs")
        kept = [F.max(c).alias(c) for c in ("approver", "reason", "blocking", "gate", "policy_version", "notes")]
        return events.groupBy("run_id").agg(F.max_by("event", "at").alias("status"), *kept, F.min("at").alias("started_at"), F.max(F.when(F.col("event") != "running", F.col("at"))).alias("finished_at"))

    def _last(self, run_id: str) -> int:
        """The largest ``seq`` of a run so far."""
        if not self._there("decisions"):
            return 0
        return self.spark.read.parquet(f"{self.path}/decisions").where(F.col("run_id") == run_id).agg(F.max("seq")).first()[0] or 0

    def _append(self, run_id: str, rows: DataFrame) -> None:
        rows = rows.withColumn("seq", F.col("seq") + self._last(run_id)).withColumn("decided_at", F.current_timestamp())
        rows.select(F.lit(run_id).alias("run_id"), *COLUMNS).write.mode("append").partitionBy("run_id").parquet(f"{self.path}/decisions")

    def record(self, run_id: str, decisions: DataFrame, policy_version: str = "1") -> None:
        """Appends a run's decisions at once."""
        self._need(run_id)
        self._append(run_id, entries(decisions, policy_version))

    def record_corrections(self, run_id: str, corrections: DataFrame, reviewer: str | None = None, notes: str = "") -> None:
        """Appends a reviewer's corrections ``(record_id, correct_keys, locus)`` to records of the same run."""
        last = self.latest(run_id).select("record_id", "amount_minor", "threshold", "n_candidates", "policy_version")
        rows = positioned(corrections.join(last, "record_id"), ["record_id", F.col("correct_keys")]).withColumnRenamed("position", "seq")
        evidence = F.to_json(F.struct("correct_keys", "locus", F.lit(notes).alias("notes")))
        self._append(run_id, rows.select(
            "record_id", F.lit("correction").alias("path"), F.lit("correction").alias("outcome"), F.array_join("correct_keys", ",").alias("key"), F.col("correct_keys").alias("keys"), F.lit(None).cast("double").alias("confidence"),
            "threshold", "amount_minor", "n_candidates", F.lit("corrected by a reviewer").alias("reason"), "policy_version", evidence.alias("evidence"), F.lit(reviewer).cast("string").alias("reviewer"), F.lit("correction").alias("kind"), "seq",
        ))

    def decisions(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/decisions").where(F.col("run_id") == run_id).orderBy("seq", "record_id")

    def latest(self, run_id: str, machine_only: bool = False) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/decisions").where(F.col("run_id") == run_id)
        return latest(rows.where("kind = 'decision'") if machine_only else rows)

    def summary(self, run_id: str) -> DataFrame:
        return self.decisions(run_id).groupBy("outcome").count()


def latest(rows: DataFrame) -> DataFrame:
    """The row with the largest ``seq`` of each record of a run."""
    w = Window.partitionBy("run_id", "record_id").orderBy(F.col("seq").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
