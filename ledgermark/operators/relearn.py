"""Learning between batches: decide, review, refit, and go on with the next batch.

Every arm decides the same batches with a ranker of its own. What a reviewer would say
of a batch becomes corrections; those of ranking and grouping, and where an arm spot-checks
a share of what it posted rightly, grow a few more trees on the arm's ranker before the
next batch, never within one. Older corrections weigh less, by a half-life in batches,
and those of suspected groups more.

Each batch leaves its decisions, corrections and rankers under ``path``, so a run that
failed goes on at the batch it failed in. Arms are decided together, as one plan with the
arm beside the record id; the loop on the driver holds the rankers and nothing else.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed, positioned
from ledgermark.operators import boost, decide, rank, settle
from ledgermark.operators.features import PAIR

#: What an arm is told: corrections, spot checks of right postings, and whether the keys are wrong on purpose.
ARMS = {"off": (False, False, False), "corrections": (True, False, False), "spot_check": (True, True, False), "placebo": (True, True, True)}
LOCI = ("blocking", "multiplicity", "ranking", "threshold", "unattributed")


def in_batches(records: DataFrame, batches: int, order=("day", "record_id")) -> DataFrame:
    """``records`` with ``batch`` from 0, in order of arrival and of nearly equal size."""
    at = checkpointed(positioned(records, list(order)))
    n = max(1, at.count())
    return at.withColumn("batch", F.floor((F.col("position") - 1) * batches / n).cast("int")).drop("position")


def _draw(seed: int, *columns):
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1_000_000)) / 1_000_000


def corrections(judged: DataFrame, candidates: DataFrame, spot_check: float, seed: int) -> DataFrame:
    """What each arm is told: ``arm, record_id, told, weight``.

    ``judged(arm, record_id, label, locus, posted, is_mult)``; the placebo is told another
    candidate than the right one, and nothing where there is none.
    """
    takes = F.create_map(*[F.lit(x) for arm, kinds in ARMS.items() for x in (arm, list(kinds))])
    kinds = judged.withColumn("_kinds", takes[F.col("arm")])
    failed = F.col("_kinds")[0] & F.col("locus").isin("ranking", "multiplicity")
    checked = F.col("_kinds")[1] & (F.col("locus") == "none") & F.col("posted") & (_draw(seed, F.col("record_id")) < spot_check)
    told = kinds.where("not is_mult").where(failed | checked).withColumn("weight", F.when(F.col("locus") == "multiplicity", 2.0).otherwise(1.0))
    wrong = told.where(F.col("_kinds")[2]).join(candidates.select("record_id", "key"), "record_id").where(F.col("key") != F.col("label"))
    wrong = wrong.groupBy("arm", "record_id").agg(F.min_by("key", F.struct(_draw(seed + 1, F.col("record_id"), F.col("key")), "key")).alias("told"), F.first("weight").alias("weight"))
    right = told.where(~F.col("_kinds")[2]).select("arm", "record_id", F.col("label").alias("told"), "weight")
    return right.unionByName(wrong.select("arm", "record_id", "told", "weight"))


def relearn(spark: SparkSession, records: DataFrame, pairs: DataFrame, first: boost.Forest, path: str, *, arms=tuple(ARMS), spot_check: float = 0.25, trees: int = 2, depth: int = 3, half_life: float = 2.0, seed: int = 7) -> DataFrame:
    """``records(record_id, account, amount_minor, day, label, is_mult, batch)`` and their ``pairs`` with features -> a row for each arm and batch.

    ``arm, batch, n, posted, right, told``, a count for each locus, ``autonomy`` (share
    posted) and ``precision`` (share of the posted that was right; null if none was).
    """
    n_batches = (records.agg(F.max("batch")).first()[0] or 0) + 1 if not records.isEmpty() else 0
    forests = _rankers(spark, path, "start")
    if forests is None:
        pairs.select("record_id", "key", *PAIR).join(records.select("record_id", "batch"), "record_id").write.partitionBy("batch").mode("overwrite").parquet(f"{path}/pairs")
        forests = {arm: first for arm in arms}
        _leave(spark, path, "start", forests)
    if n_batches:
        pairs = spark.read.parquet(f"{path}/pairs")
    for b in range(n_batches):
        left = _rankers(spark, path, b)
        if left is not None:
            forests = left
            continue
        here, rows = records.where(F.col("batch") == b).drop("batch"), pairs.where(F.col("batch") == b).drop("batch")
        judged, cand = _judged(here, rows, forests)
        judged.write.mode("overwrite").parquet(f"{path}/decided/batch={b}")
        judged = spark.read.parquet(f"{path}/decided/batch={b}")
        corrections(judged, cand, spot_check, seed).write.mode("overwrite").parquet(f"{path}/told/batch={b}")
        if b + 1 < n_batches:
            told = spark.read.option("basePath", f"{path}/told").parquet(*[f"{path}/told/batch={k}" for k in range(b + 1)])
            told = checkpointed(told.withColumn("weight", F.col("weight") * F.pow(F.lit(0.5), (F.lit(b) - F.col("batch")) / half_life)))

            def refitted(arm, told=told, upto=b):
                return boost_on(forests[arm], told.where(F.col("arm") == arm), pairs.where(F.col("batch") <= upto), trees, depth) if ARMS[arm][0] else forests[arm]

            with ThreadPoolExecutor(len(arms)) as pool:
                forests = dict(zip(arms, pool.map(refitted, arms), strict=True))
        _leave(spark, path, b, forests)
    return _report(spark, path, n_batches)


def _leave(spark: SparkSession, path: str, step, forests: dict[str, boost.Forest]) -> None:
    """Rankers after a step: one file, written last, so what is there is whole."""
    spark.createDataFrame([(arm, f.text()) for arm, f in forests.items()], "arm string, forest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/rankers/step={step}")


def _rankers(spark: SparkSession, path: str, step) -> dict[str, boost.Forest] | None:
    try:
        rows = spark.read.schema("arm string, forest string").parquet(f"{path}/rankers/step={step}").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return {r.arm: boost.Forest.read(r.forest) for r in rows} or None


def boost_on(forest: boost.Forest, told: DataFrame, pairs: DataFrame, trees: int, depth: int) -> boost.Forest:
    """More trees on the candidates of corrected records."""
    rows = pairs.join(told.select("record_id", F.col("told").alias("label"), "weight"), "record_id").withColumn("is_mult", F.lit(False))
    blocks = boost.packed(rank.training_pairs(rows), forest, "weight")
    return forest if blocks.isEmpty() else boost.grow(forest, blocks, trees, depth, least_rows=5)


def _judged(here: DataFrame, rows: DataFrame, forests: dict[str, boost.Forest]) -> tuple[DataFrame, DataFrame]:
    """Decisions of all arms with what a reviewer would say, and the candidates."""
    names = list(forests)

    @F.pandas_udf("array<double>")
    def margins(*columns):
        import numpy as np
        import pandas as pd

        values = np.stack([np.asarray(c, float) for c in columns], 1)
        first = next(iter(forests.values()))
        bins = first.bins(values)  # a refit keeps its ranker's cuts
        return pd.Series(list(np.stack([f.margins(bins) for f in forests.values()], 1)))

    arm = F.explode(F.array(*[F.lit(n) for n in names])).alias("arm")
    scored = rows.select("record_id", "key", "amount_exact", F.posexplode(margins(*PAIR)).alias("_a", "score"))
    scored = scored.select(F.struct(F.get(F.array(*[F.lit(n) for n in names]), F.col("_a")).alias("arm"), "record_id").alias("record_id"), "key", "amount_exact", "score")
    scored = checkpointed(scored)
    bank = here.select("*", arm).withColumn("record_id", F.struct("arm", "record_id")).drop("arm")
    cand = scored.select("record_id", "key")
    said = decide.decisions(bank, cand, scored, rank.ranked(scored.select("record_id", "key", "score")))
    judged = said.join(bank.select("record_id", "label", "is_mult"), "record_id")
    judged = checkpointed(judged)
    loci = settle.loci(judged, cand)
    posted = F.col("outcome") == "posted"
    out = judged.join(loci, "record_id").select("record_id.arm", "record_id.record_id", "label", "is_mult", "locus", posted.alias("posted"), (posted & (F.col("key") == F.col("label"))).alias("right"))
    return out, rows.select("record_id", "key")


def _report(spark: SparkSession, path: str, n_batches: int) -> DataFrame:
    schema = "arm string, batch int, n long, posted long, right long, told long, " + ", ".join(f"{x} long" for x in LOCI) + ", autonomy double, precision double"
    if not n_batches:
        return spark.createDataFrame([], schema)
    decided = spark.read.parquet(f"{path}/decided").groupBy("arm", "batch").agg(F.count("*").alias("n"), F.count_if("posted").alias("posted"), F.count_if("right").alias("right"), *[F.count_if(F.col("locus") == x).alias(x) for x in LOCI])
    told = spark.read.schema("arm string, record_id string, told string, weight double, batch int").parquet(f"{path}/told").groupBy("arm", "batch").agg(F.count("*").alias("told"))
    both = decided.join(told, ["arm", "batch"], "left")
    return both.select("arm", "batch", "n", "posted", "right", F.coalesce("told", F.lit(0)).alias("told"), *LOCI, F.round(F.col("posted") / F.col("n"), 6).alias("autonomy"), F.round(F.try_divide("right", "posted"), 6).alias("precision"))
