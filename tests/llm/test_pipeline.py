"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgermark.llm import pieces
from ledgermark.llm.common import written
from tests.conftest import DATA
from tests.llm.test_jaccard import grouped, shingles


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, f in cp.STAGES:
        docs.append(written(f(spark, docs[-1], DATA), "test"))
    return docs


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "SentencePiece encoding"]
    assert all(d.columns == stages[0].columns for d in stages[1:5]) and "ids_sha256" in stages[5].columns


def test_quality_rejects_junk_and_keeps_clean(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    at = labels.join(stages[1].select("doc_id", F.lit(True).alias("kept")), "doc_id", "left")
    assert at.where("quality = 1 and kept is null").count() <= 0.03 * at.where("quality = 1").count()
    assert at.where("quality = 0 and kept").count() <= 0.1 * at.where("quality = 0").count()


def test_line_dedup_leaves_each_long_line_once(stages):
    seen = Counter(x for r in stages[2].collect() for x in r["text"].split("\n") if len(x) >= 20)
    before = Counter(x for r in stages[1].collect() for x in r["text"].split("\n") if len(x) >= 20)
    assert max(seen.values()) == 1 and set(seen) <= set(before) and len(seen) > 0.97 * len(before)
    assert stages[2].where(F.col("n_chars") != F.length("text")).count() == 0


def test_near_dedup_keeps_the_smallest_id_of_each_group(stages):
    docs = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    groups = grouped([shingles(t) for _, t in docs])
    assert {r["doc_id"] for r in stages[3].collect()} == {docs[g][0] for g in groups}


def test_mixing_takes_words_near_target(stages):
    size = lambda d: {r["source"]: r["n"] for r in d.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    before, after = size(stages[3]), size(stages[4])
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) < 0.1 * sum(before.values())
    assert all(after.get(s, 0) <= 2 * n for s, n in before.items())
    assert max(r["count"] for r in stages[4].groupBy("doc_id").count().collect()) <= 2


def test_encoding_equals_the_library(stages):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = sorted((r["doc_id"], hashlib.sha256(",".join(map(str, sp.encode(r["text"]))).encode()).hexdigest()) for r in stages[4].collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in stages[5].collect()) == want


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, f in cp.STAGES:
        docs = written(f(spark, docs, DATA), "test")
        assert docs.count() == 0


def test_null_and_repeated_rows(spark):
    kind = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (6, "a line that is long enough to count, and then some", "en", None, 50), (6, "another text under the same id, also long enough", "en", "s", 48)]
    docs = spark.createDataFrame(rows, kind)
    for _, f in cp.STAGES:
        docs = written(f(spark, docs, DATA), "test")
    assert docs.count() > 0


def test_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    for c in ("_quality", "_line_dedup", "_entities", "k", "h", "box", "gone", "copies", "fp", "kept", "key", "component"):
        docs = docs.withColumn(c, F.lit("x"))
    for _, f in cp.STAGES:
        docs = written(f(spark, docs, DATA), "test")
    assert docs.count() > 0


def test_near_dedup_takes_what_simhash_links(spark):
    """Texts of one repeated phrase and ends of their own: nearly no shingle in common, but one fingerprint, as repeats count."""
    kind = spark.read.parquet(f"{DATA}/documents.parquet").schema
    texts = ["alpha beta gamma " * 200 + " ".join(f"{end}{i}" for i in range(12)) for end in ("x", "y")]
    docs = spark.createDataFrame([(3, texts[0], "en", "s", 1), (1, texts[1], "en", "s", 1)], kind)
    assert cp.jaccard.groups(docs).where("doc_id = component").count() == 2
    assert [r["doc_id"] for r in cp.near_dedup(spark, docs, DATA).collect()] == [1]
