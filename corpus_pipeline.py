"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of ``documents``. The driver writes each
stage's rows as Parquet and reads them again as the next one's docs; :func:`run` does
the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm import jaccard, lines, mixing, pieces, quality, simhash
from ledgermark.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier rejects go."""
    return quality.kept(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: later copies of lines go. A document whose lines have all gone goes too; one that was empty before stays."""
    got = lines.dedup_lines(docs.select(*COLUMNS), short=True)
    emptied = (F.col("_line_dedup.n_lines") > 0) & (F.col("_line_dedup.kept_lines") == 0)
    return got.where(~emptied).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group that SimHash links the document with the smallest id stays.

    Three differing bits miss most near copies, so what SimHash leaves is joined by its
    shingles of five words, where a similarity of 0.8 or more makes a near copy.

    Rows that share that id stay together; a group of null ids alone stays whole.
    """
    docs = written(_smallest(docs.select(*COLUMNS), simhash.groups(docs.select("doc_id", "text"))), "pipeline-simhash")
    return _smallest(docs, jaccard.groups(docs))


def _smallest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    groups = groups.where(F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull()))
    kept = written(groups.select(F.col("doc_id").alias("kept")).distinct(), "pipeline-kept")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as many times as the mix takes it, 0 to 2."""
    got = mixing.mixed(docs.select(*COLUMNS))
    return got.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids, and digests of ids and of the decoded text."""
    return pieces.encode_documents(docs, pieces.model_path(), with_ids=False)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: Rounding at random and naive Bayes in floating point have no exact SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
