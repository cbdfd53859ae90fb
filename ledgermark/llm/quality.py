"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes log odds over binned text measures, counted
over every labelled row. Its host and path (here source, and source with language) add
a prior: over all documents, labelled or not, the mean of the classifier's posteriors
is taken by path, host and globally; a host is shrunk toward the global mean and a path
toward its host, by as many pseudo documents as a method-of-moments fit of the spread
between hosts, or between paths, gives. The prior's log odds and the evidence add up.

Texts are measured once: their bins are written without the text, and all that follows
reads these. Everything but the final row is grouped aggregation with partial sums, so a
host that holds a third of all rows is no burden. What goes to the driver is the table of
bins, whose size is fixed by the measures (:data:`BINS`), and a few sums.

Cases: null, empty and wordless texts fall into bins of their own; null hosts and paths
are groups of their own; labels that are null, or of unknown documents, are ignored, and
a key labelled more than once counts by each label; without labels of both classes there
is no evidence and every document is kept at 0.5; repeated rows give repeated results;
an empty table gives an empty result; extra columns stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.common import table, written

#: Bins of each measure; bin 0 is for documents without words.
BINS = {"marks": 32, "lone": 18, "variety": 160, "length": 24, "common": 18, "stutter": 18}
SMOOTH = 4.0


def measures(text: Column) -> Column:
    """A struct of bin numbers of a text."""
    words = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")
    return F.struct(text.alias("text"), F.length(text).alias("chars"), words.alias("words"), F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,]+", "")).alias("marks"))


def binned(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_bins``, an array of bin numbers in the order of :data:`BINS`."""
    m = docs.withColumn("_m", measures(F.col(text)))
    m = m.withColumn("_s", F.struct(F.size("_m.words").alias("n"), F.size(F.array_distinct("_m.words")).alias("kinds"), F.col("_m.chars").alias("chars"), F.col("_m.marks").alias("marks"), F.size(F.filter("_m.words", lambda w: F.length(w) == 1)).alias("lone"), F.size(F.filter("_m.words", lambda w: F.length(w) <= 3)).alias("short"), F.size(F.filter("_m.words", lambda w, i: (i > 0) & (w == F.get("_m.words", i - 1)))).alias("stutter")))
    n = F.col("_s.n")

    def bin_of(x: Column, name: str) -> Column:
        return F.when(n > 0, 1 + F.least(F.lit(BINS[name] - 2), F.greatest(F.lit(0), F.floor(x)))).otherwise(0).cast("int")

    size = F.least(F.lit(13), F.floor(F.log2(n.cast("double"))))
    bins = [
        bin_of(F.log2(1 + 4096 * F.col("_s.marks") / F.col("_s.chars")) * 2, "marks"),
        bin_of(16 * F.col("_s.lone") / n, "lone"),
        bin_of(size * 11 + F.floor(10 * F.col("_s.kinds") / n), "variety"),
        bin_of(F.col("_s.chars") / n, "length"),
        bin_of(16 * F.col("_s.short") / n, "common"),
        bin_of(16 * F.col("_s.stutter") / n, "stutter"),
    ]
    return m.withColumn("_bins", F.coalesce(F.array(*bins), F.array(*[F.lit(0)] * len(bins)))).drop("_m", "_s")


def weights(binned_labels: DataFrame) -> tuple[list[list[float]] | None, float]:
    """Log odds of each bin and of a document from rows ``(_bins, label)``; None and 0 if a class has no rows."""
    rows = binned_labels.select("label", F.posexplode("_bins").alias("measure", "bin")).groupBy("measure", "bin").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).collect()
    total = [sum(r.good for r in rows if r.measure == 0), sum(r.bad for r in rows if r.measure == 0)]
    if not min(total):
        return None, 0.0
    out = [[0.0] * n for n in BINS.values()]
    for r in rows:
        share = (r.good + r.bad) / sum(total)
        out[r.measure][r.bin] = math.log((r.good + SMOOTH * share) / (total[0] + SMOOTH)) - math.log((r.bad + SMOOTH * share) / (total[1] + SMOOTH))
    return out, math.log(total[0] / total[1])


def evidence(odds: list[list[float]] | None) -> Column:
    if odds is None:
        return F.lit(0.0)
    return sum((F.element_at(F.array(*[F.lit(x) for x in column]), F.get("_bins", F.lit(i)) + 1) for i, column in enumerate(odds)), F.lit(0.0))


def _strength(groups: DataFrame, mean: str, within: str) -> float:
    """Pseudo documents of a beta prior whose spread between groups fits, by moments."""
    n, between, noise = groups.where("n > 1").agg(F.count("*"), F.avg(F.pow(F.col(mean) - F.col(within), 2)), F.avg(F.col(within) * (1 - F.col(within)) / F.col("n"))).first()
    if not n or between is None:
        return 100.0
    spread = max(between - noise, 1e-6)
    level = groups.agg(F.avg(within)).first()[0]
    return min(1e6, max(1.0, level * (1 - level) / spread - 1))


def judged(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", host: Column | str = "source", path: Column | str = "lang", label_key: str = "doc_id", label: str = "quality", cut: float = 0.3) -> DataFrame:
    """A row for each of ``docs``, without its text: ``_key, _h`` (a hash of the text), ``_host, _path`` and evidence, prior, p and keep."""
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))
    given = labels.select(F.col(label_key).alias("_key"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    slim = docs.select(F.col(key).alias("_key"), _hashed(text), host.cast("string").alias("_host"), path.cast("string").alias("_path"), F.col(text).alias("_text"))
    slim = written(binned(slim, "_text").drop("_text"), "quality-bins")
    odds, base = weights(slim.join(given, "_key"))
    own = 1 / (1 + F.exp(-(evidence(odds) + F.lit(base))))
    sums = slim.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(own).alias("good"))
    paths = written(sums, "quality-paths")
    hosts = written(paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "quality-hosts")
    n, total = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = min(1 - 1e-6, max(1e-6, total / n)) if n else 0.5
    hosts = hosts.withColumn("all", F.lit(mean)).withColumn("mean", F.col("good") / F.col("n"))
    weight = _strength(hosts, "mean", "all")
    hosts = hosts.select(F.col("_host").alias("_h_host"), ((F.col("good") + weight * F.lit(mean)) / (F.col("n") + weight)).alias("host_p"))
    both = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h_host"))).withColumn("mean", F.col("good") / F.col("n"))
    weight = _strength(both, "mean", "host_p")
    prior = written(both.select(F.col("_h_host"), F.col("_path").alias("_p"), F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("good") + weight * F.col("host_p")) / (F.col("n") + weight))).alias("prior")), "quality-priors")
    at = slim.join(prior, F.col("_host").eqNullSafe(F.col("_h_host")) & F.col("_path").eqNullSafe(F.col("_p")))
    prior_p = F.col("prior") if odds is not None else F.lit(0.5)
    out = at.select("_key", "_h", "_host", "_path", evidence(odds).alias("evidence"), prior_p.alias("prior"))
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior"))))))
    return out.withColumn("p", p).withColumn("keep", F.col("p") >= cut)


def _hashed(text: str) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("_h")


def _beside(docs: DataFrame, marks: DataFrame, how: str, key: str, text: str, host: Column | str, path: Column | str) -> DataFrame:
    """``docs``, as rows ``_row``, joined with rows of :func:`judged` that are one for each key, text, host and path."""
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_k"), _hashed(text).alias("_x"), host.cast("string").alias("_a"), path.cast("string").alias("_b"))
    same = F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_x") == F.col("_h")) & F.col("_a").eqNullSafe(F.col("_host")) & F.col("_b").eqNullSafe(F.col("_path"))
    return rows.join(marks, same, how)


def scored(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", host: Column | str = "source", path: Column | str = "lang", **rest) -> DataFrame:
    """The rows of ``docs`` with ``_quality`` (in place of a column so named): a struct of evidence, prior, p and keep."""
    docs = docs.drop("_quality")
    marks = judged(docs, labels, key=key, text=text, host=host, path=path, **rest).dropDuplicates(["_key", "_h", "_host", "_path"])
    return _beside(docs, marks, "inner", key, text, host, path).select("_row.*", F.struct("evidence", "prior", "p", "keep").alias("_quality"))


def kept(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", host: Column | str = "source", path: Column | str = "lang", **rest) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    gone = judged(docs, labels, key=key, text=text, host=host, path=path, **rest).where(~F.col("keep")).select("_key", "_h", "_host", "_path").distinct()
    return _beside(docs, gone, "left_anti", key, text, host, path).select("_row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select(F.col("_key").alias("doc_id"), F.round("evidence", 6).alias("evidence"), F.round("prior", 6).alias("prior"), F.round("p", 6).alias("p_quality"), "keep")
