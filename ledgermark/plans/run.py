"""Entry points: a recorded batch, a pair of uploads, and a bundle of models."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed
from ledgermark.operators import blocking, decide, features, models, rank, settle, solver
from ledgermark.operators.audit import Trail
from ledgermark.sources import csv_files


def plan(bank: DataFrame, ledger: DataFrame, slack: int = 7, bundle: Bundle | None = None, rules: bool = True, **options) -> DataFrame:
    """Decisions by a bundle's models, else by rules; with neither every record is queued as ``no_ranker``."""
    if bundle is None and not rules:
        return decide.without_ranker(bank, **{k: x for k, x in options.items() if k == "policy"})
    cand = blocking.candidates(bank, ledger, slack)
    pairs = features.pairs(cand, bank, features.key_stats(ledger))
    if bundle is None:
        return decide.decisions(bank, cand, pairs, rank.ranked(rank.rules_score(pairs)), **options)
    scored = models.rank_scores(bundle.ranker, pairs)
    many = models.multiple_scores(bundle.detector, features.mult_features(bank, pairs, bundle.prior))
    best = rank.ranked(scored)
    sure = models.calibrated(bundle.calibrator, best).select("record_id", F.col("confidence").alias("_sure"))
    return decide.decisions(bank, cand, pairs, best.join(sure, "record_id", "left"), p_multiple=many, calibrate=lambda _: F.col("_sure"), **options)


def run_batch(bank: DataFrame, ledger: DataFrame, trail: Trail, approver: str, bundle_path: str | None = None, **options) -> tuple[str, DataFrame]:
    """Decides and records a run; a failure marks it failed and is raised again.

    With ``bundle_path`` the models there decide; if there are none, rules don't stand in
    for them, and every record is queued as ``no_ranker``.
    """
    run_id = trail.start_run(approver)
    try:
        if bundle_path is not None:
            bundle = Bundle.found(bank.sparkSession, bundle_path)
            options |= {"bundle": bundle, "rules": bundle is not None}
        trail.record(run_id, plan(bank, ledger, **options))
    except Exception as e:
        trail.fail_run(run_id, f"{type(e).__name__}: {e}"[:500])
        raise
    trail.finish_run(run_id)
    return run_id, trail.summary(run_id)


def proposals(bank: DataFrame, ledger: DataFrame, decisions: DataFrame, slack: int = 7) -> DataFrame:
    """For records suspected to be grouped, the unique smallest combination; it is proposed, never posted."""
    todo = decisions.where("outcome = 'suspected_grouped'").select("record_id", F.col("amount_minor").alias("target"))
    pool = solver.pools(blocking.candidates(bank, ledger, slack).join(todo, "record_id", "left_semi"), ledger)
    return solver.solve(todo, pool)


def reconcile_files(spark: SparkSession, bank_path: str, ledger_path: str, backend=None) -> dict:
    """Two uploads -> decisions, proposals, refused rows, aging and layouts. Confidence is not validated for such data."""
    bank, bad_bank, bank_layout = csv_files.read_bank(spark, bank_path, backend)
    ledger, bad_ledger, ledger_layout = csv_files.read_ledger(spark, ledger_path, backend)
    decided = checkpointed(plan(bank, ledger))
    return {
        "decisions": decided, "proposals": proposals(bank, ledger, decided), "refused_bank": bad_bank, "refused_ledger": bad_ledger,
        "aging": settle.aging(decided), "layouts": (bank_layout, ledger_layout), "confidence_validated_for_this_data": False,
    }


@dataclass
class Bundle:
    """Models that were trained together; the order of features is part of it."""

    ranker: GBTClassificationModel
    detector: GBTClassificationModel
    calibrator: PipelineModel
    prior: tuple[DataFrame, float, float]

    def save(self, spark: SparkSession, path: str) -> None:
        for name in ("ranker", "detector", "calibrator"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        self.prior[0].write.mode("overwrite").parquet(f"{path}/prior")
        manifest = {"pair": list(features.PAIR), "mult": list(features.MULT), "median": self.prior[1], "rate": self.prior[2]}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
        if manifest["pair"] != list(features.PAIR) or manifest["mult"] != list(features.MULT):
            raise ValueError("the bundle was trained with other features, or in another order")
        prior = (spark.read.parquet(f"{path}/prior"), manifest["median"], manifest["rate"])
        return Bundle(GBTClassificationModel.load(f"{path}/ranker"), GBTClassificationModel.load(f"{path}/detector"), PipelineModel.load(f"{path}/calibrator"), prior)

    @staticmethod
    def found(spark: SparkSession, path: str) -> Bundle | None:
        """The bundle at ``path``; None if nothing is there. One that can't be read is an error."""
        try:
            return Bundle.load(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None


def train(bank: DataFrame, ledger: DataFrame, splits: DataFrame, slack: int = 7, trees: int = 20) -> Bundle:
    """``splits(match_id, split)``: ranker and detector on ``train``, the calibrator on ``val``. A grouped record's top key is never right."""
    at = bank.join(splits, "match_id")
    prior = features.account_prior(at.where("split = 'train'"))
    pairs = checkpointed(features.pairs(blocking.candidates(bank, ledger, slack), bank, features.key_stats(ledger)))
    of = at.select("record_id", "split")
    ranker = models.fit_ranker(rank.training_pairs(pairs.join(of.where("split = 'train'"), "record_id")), trees)
    rows = features.mult_features(bank, pairs, prior).join(at.select("record_id", "split", F.col("is_mult").cast("int").alias("is_mult")), "record_id")
    detector = models.fit_detector(rows.where("split = 'train'"), trees)
    best = rank.ranked(models.rank_scores(ranker, pairs.join(of.where("split = 'val'"), "record_id"))).join(bank, "record_id")
    _, calibrator = models.pick_calibrator(best.select("record_id", "margin", (~F.col("is_mult") & (F.col("key") == F.col("label"))).alias("right")))
    return Bundle(ranker, detector, calibrator, prior)


def export_json(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as JSON lines below ``path``; what is there already is not replaced."""
    for name, df in frames.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")


def checked_uploads(bank: DataFrame, ledger: DataFrame, most_bank: int | None = None, most_ledger: int | None = None) -> None:
    """Raises where an upload holds more rows than its caller allows; by default there is no limit."""
    for name, df, most in (("bank", bank, most_bank), ("ledger", ledger, most_ledger)):
        if most is not None and df.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} {name} rows")
