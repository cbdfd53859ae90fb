"""Trained models in place of the rules: ranker, detector of grouped records, calibration."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed
from ledgermark.operators.evaluate import reliability
from ledgermark.operators.features import MULT, PAIR


def _fit(rows: DataFrame, columns, label: str, trees: int, depth: int, seed: int):
    n, pos = rows.agg(F.count("*"), F.sum(label)).first()
    weight = F.when(F.col(label) == 1, (n - pos) / max(pos, 1)).otherwise(1.0)
    made = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows.withColumn("w", weight).withColumn("y", F.col(label).cast("double")))
    return GBTClassifier(labelCol="y", weightCol="w", maxIter=trees, maxDepth=depth, seed=seed).fit(made)


def _margin(model, rows: DataFrame, columns) -> DataFrame:
    made = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)
    return model.transform(made).withColumn("score", vector_to_array("rawPrediction")[1]).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_ranker(pairs: DataFrame, trees: int = 20, depth: int = 5, seed: int = 7):
    """From :func:`rank.training_pairs`; ranked on the raw margin."""
    return _fit(pairs, PAIR, "is_label", trees, depth, seed)


def rank_scores(model, pair_rows: DataFrame) -> DataFrame:
    return _margin(model, pair_rows, PAIR).select("record_id", "key", "score")


def fit_detector(rows: DataFrame, trees: int = 20, depth: int = 4, seed: int = 7):
    """``rows`` hold the features of :data:`MULT` and ``is_mult`` as 0 or 1."""
    return _fit(rows, MULT, "is_mult", trees, depth, seed)


def multiple_scores(model, rows: DataFrame, *keep: str) -> DataFrame:
    return _margin(model, rows, MULT).select("record_id", F.col("p").alias("p_multiple"), *keep)


def fit_isotonic(rows: DataFrame):
    """``rows(margin, right)`` of validation records, the top candidate of each being right or not."""
    return IsotonicRegression(featuresCol="margin", labelCol="right").fit(rows.select(F.col("margin").cast("double"), F.col("right").cast("double")))


def fit_platt(rows: DataFrame) -> PipelineModel:
    """A sigmoid of the margin, with the weight's square at unit strength against the summed loss; rows as for :func:`fit_isotonic`."""
    n = rows.count()
    sigmoid = LogisticRegression(labelCol="right", regParam=1 / max(n, 1), standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="features"), sigmoid]).fit(rows.select(F.col("margin").cast("double"), F.col("right").cast("double")))


def calibrated(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows.where("margin is not null"))
    sure = vector_to_array("probability")[1] if "probability" in out.columns else F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))
    return out.withColumn("confidence", sure).select(*rows.columns, "confidence")


def calibration_error(model, rows: DataFrame) -> float:
    at = calibrated(model, rows).select(F.col("confidence").alias("score"), F.col("right").cast("double").alias("truth"))
    return reliability(at).agg(F.coalesce(F.sum("ece_part"), F.lit(0.0))).first()[0]


def pick_calibrator(rows: DataFrame) -> tuple[str, PipelineModel]:
    """``rows(record_id, margin, right)`` of validation records -> kind and model of the better calibrator.

    Both kinds are fitted on one half of the records, by a hash of their id, and compared
    by calibration error on the other; the better one, the sigmoid of two equal ones, is
    fitted again on all rows. Nothing is chosen on the records that report it.
    """
    rows = checkpointed(rows.where("margin is not null").select("margin", F.col("right").cast("double").alias("right"), (F.pmod(F.xxhash64("record_id"), F.lit(2)) == 0).alias("fitted")))
    kinds = {"platt": fit_platt, "isotonic": lambda at: PipelineModel(stages=[fit_isotonic(at)])}
    fit_on, judge_on = rows.where("fitted"), rows.where("not fitted")
    errors = {kind: calibration_error(fit(fit_on), judge_on) for kind, fit in kinds.items()}
    kind = min(errors, key=errors.get)
    return kind, kinds[kind](rows)


def importances(model, columns) -> list[tuple[str, float]]:
    return sorted(zip(columns, (float(x) for x in model.featureImportances.toArray()), strict=True), key=lambda x: -x[1])
