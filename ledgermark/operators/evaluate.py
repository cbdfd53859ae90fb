"""Measures of blocking, ranking, detection and calibration; splits and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed, positioned

#: Columns that only exist once the outcome is known.
OUTCOME_COLUMNS = ("matchrule", "matchedby", "matchdate")


def blocking_report(bank: DataFrame, cand: DataFrame) -> DataFrame:
    """Recall over single-key records, and sizes of candidate sets, over all records and over those with any."""
    n = cand.groupBy("record_id").agg(F.count("*").alias("n"))
    hit = cand.withColumnRenamed("key", "label").withColumn("hit", F.lit(1))
    at = bank.select("record_id", "label", "is_mult").join(n, "record_id", "left").join(hit, ["record_id", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = F.when(F.col("n") > 0, F.col("n"))
    single = F.when(~F.col("is_mult"), F.coalesce("hit", F.lit(0)))
    return at.agg(
        F.count("*").alias("n_records"), F.round(F.avg(single), 6).alias("recall"), F.count_if(F.col("n") == 0).alias("n_without"),
        F.round(F.avg("n"), 6).alias("mean_all"), F.percentile("n", 0.5).alias("median_all"), F.percentile("n", 0.95).alias("p95_all"), F.max("n").alias("max_all"),
        F.round(F.avg(some), 6).alias("mean_some"), F.percentile(some, 0.5).alias("median_some"), F.percentile(some, 0.95).alias("p95_some"),
    )


def top1_mrr(ranks: DataFrame) -> DataFrame:
    """``ranks(record_id, key, label, rank)`` of records whose label is a candidate."""
    right = ranks.where("key = label")
    return right.agg(F.count("*").alias("n"), F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("top1"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


def confusion(scores: DataFrame, at: float) -> DataFrame:
    """``scores(score, truth)`` -> counts, precision, recall and F1 at a threshold."""
    said, true = F.col("score") >= at, F.col("truth") == 1
    out = scores.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(F.try_divide(F.lit(2.0) * F.col("tp"), F.lit(2.0) * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def _by_score(scores: DataFrame) -> DataFrame:
    by = scores.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("pos"))
    return positioned(by, [F.col("score").desc()], {"cum_n": F.col("n"), "cum_pos": F.col("pos")})


def pr_auc(scores: DataFrame) -> DataFrame:
    """Average precision; equal scores are one step."""
    at = _by_score(scores)
    return at.agg(F.round(F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), F.sum("pos")), 6).alias("pr_auc"), F.sum("n").alias("n"), F.sum("pos").alias("positives"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """By rank sums, equal scores at their mean rank."""
    at = _by_score(scores)
    # pairs won: a positive over the negatives behind it, half of those beside it
    neg_behind = F.col("all_n") - F.col("all_pos") - (F.col("cum_n") - F.col("cum_pos"))
    sums = at.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    at = at.crossJoin(F.broadcast(sums))  # one row
    won = F.sum(F.col("pos") * (neg_behind + 0.5 * (F.col("n") - F.col("pos"))))
    return at.agg(F.round(F.try_divide(won, F.first("all_pos") * (F.first("all_n") - F.first("all_pos"))), 6).alias("roc_auc"))


def reliability(scores: DataFrame, bins: int = 10) -> DataFrame:
    """A row for each bin of ``score``: n, mean score, share right, and its part of the calibration error."""
    total = scores.agg(F.count("*").alias("total"))
    by = scores.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.avg("truth").alias("t"), F.avg(F.pow(F.col("score") - F.col("truth"), 2)).alias("b"))
    part = F.col("n") / F.col("total")
    return by.crossJoin(F.broadcast(total)).select("bin", "n", F.round("m", 6).alias("mean_score"), F.round("t", 6).alias("share_right"), F.round(F.abs(F.col("m") - F.col("t")) * part, 6).alias("ece_part"), F.round(F.col("b") * part, 6).alias("brier_part"))


def alert_budget(scores: DataFrame, budgets=(0.05, 0.10, 0.15)) -> DataFrame:
    """Precision and recall among the top share of ``scores(id, score, truth)``."""
    at = positioned(scores, [F.col("score").desc(), "id"])
    n, pos = scores.agg(F.count("*"), F.count_if(F.col("truth") == 1)).first()
    tops = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(int(n * b)).alias("top")) for b in budgets])
    rows = at.select("position", "truth", F.explode(tops).alias("b")).where(F.col("position") <= F.col("b.top"))
    out = rows.groupBy("b.budget", "b.top").agg(F.sum("truth").alias("hits"))
    return out.select("budget", F.col("top").cast("long").alias("alerts"), F.col("hits").cast("long").alias("hits"), F.round(F.col("hits") / F.col("top"), 6).alias("precision"), F.round(F.col("hits") / F.lit(max(pos, 1)), 6).alias("recall"))


def nmi(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information of two columns over the mean of their entropies; 0 where both are constant."""
    joint = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    px, py = Window.partitionBy("x"), Window.partitionBy("y")
    total = joint.agg(F.sum("n").alias("total"))
    at = joint.withColumn("nx", F.sum("n").over(px)).withColumn("ny", F.sum("n").over(py)).crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("total")
    mi = F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny"))))
    hx, hy = -F.sum(p * F.log(F.col("nx") / F.col("total"))), -F.sum(p * F.log(F.col("ny") / F.col("total")))
    return at.agg(mi.alias("mi"), hx.alias("hx"), hy.alias("hy")).select(F.lit(x).alias("column_name"), F.round(F.coalesce(F.try_divide(F.lit(2.0) * F.col("mi"), F.col("hx") + F.col("hy")), F.lit(0.0)), 6).alias("nmi"))


def leakage(rows: DataFrame, columns: list[str], label: str, at: float = 0.95) -> DataFrame:
    """``column_name, nmi, suspicious`` of every column against the label, in one pass: rows fan out to a count for each column and value."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("x")) for c in columns]))
    joint = rows.select(values.alias("v"), F.col(label).alias("y")).groupBy("v.column_name", "v.x", "y").agg(F.count("*").alias("n"))
    # a null is a value; so that windows spread, sums by value and by label are grouped and joined
    joint = checkpointed(joint)
    nx = joint.groupBy(F.col("column_name").alias("_c"), F.col("x").alias("_x")).agg(F.sum("n").alias("nx"))
    ny = joint.groupBy(F.col("column_name").alias("_d"), F.col("y").alias("_y")).agg(F.sum("n").alias("ny"))
    total = joint.groupBy(F.col("column_name").alias("_e")).agg(F.sum("n").alias("t"))
    all_ = joint.join(nx, (F.col("column_name") == F.col("_c")) & F.col("x").eqNullSafe(F.col("_x"))).join(ny, (F.col("column_name") == F.col("_d")) & F.col("y").eqNullSafe(F.col("_y"))).join(total, F.col("column_name") == F.col("_e"))
    p = F.col("n") / F.col("t")
    sums = all_.groupBy("column_name").agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"), (-F.sum(p * F.log(F.col("nx") / F.col("t")))).alias("hx"), (-F.sum(p * F.log(F.col("ny") / F.col("t")))).alias("hy"))
    return sums.select("column_name", F.round(F.coalesce(F.try_divide(F.lit(2.0) * F.col("mi"), F.col("hx") + F.col("hy")), F.lit(0.0)), 6).alias("nmi")).withColumn("suspicious", F.col("nmi") >= at)


def suspicious(rows: DataFrame, columns: list[str], label: str, at: float = 0.95, least: int = 20) -> list[str]:
    """Columns that nearly give the label away; numeric ones of over 20 values in 20 quantiles."""
    if rows.limit(least).count() < least:
        return []
    numeric = [c for c in columns if rows.schema[c].dataType.typeName() in ("double", "float", "long", "integer", "decimal")]
    if numeric:
        kinds = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in numeric]).first()
        many = [c for c in numeric if kinds[c] > 16]  # the estimate errs; 20 is decided on the cuts below
        cuts = dict(zip(many, rows.approxQuantile(many, [i / 20 for i in range(1, 20)], 0.001), strict=True)) if many else {}
        few = {c for c in many if rows.select(c).distinct().limit(21).count() <= 20}
        rows = rows.withColumns({c: sum((F.when(F.col(c) > q, 1).otherwise(0) for q in sorted(set(cuts[c]))), F.lit(0)) for c in many if c not in few})
    return sorted(r["column_name"] for r in leakage(rows, columns, label, at).where("suspicious").collect())


def assert_no_outcome_columns(df: DataFrame, more=()) -> None:
    bad = sorted(c for c in df.columns if c.lower() in {*OUTCOME_COLUMNS, *(m.lower() for m in more)})
    if bad:
        raise ValueError(f"outcome columns among features: {bad}")


def temporal_split(rows: DataFrame, group: str = "match_id", day: str = "day", train: float = 0.7, val: float = 0.1) -> DataFrame:
    """``group, first_day, split``: whole groups by first day; groups without a day train."""
    groups = checkpointed(rows.groupBy(F.col(group).alias("grp")).agg(F.min(day).alias("first_day")))
    return _split_of(groups, groups, train, val)


def with_split(rows: DataFrame, group: str = "match_id", day: str = "day", train: float = 0.7, val: float = 0.1) -> DataFrame:
    """``rows`` with the ``split`` of :func:`temporal_split`, dealt out by group once and written; rows without a group are left out."""
    known = rows.where(F.col(group).isNotNull())
    first = Window.partitionBy(group).orderBy(F.col(day).asc_nulls_last())
    at = checkpointed(known.withColumns({"first_day": F.first(day).over(first), "_lead": F.row_number().over(first) == 1, "grp": F.col(group)}))
    # together they are a group, which counts where the shares end
    without = rows.where(F.col(group).isNull()).agg(F.min(day).alias("first_day"), F.count("*").alias("n")).where("n > 0")
    groups = at.where("_lead").select("grp", "first_day").union(without.select(F.lit(None).cast(at.schema["grp"].dataType), "first_day"))
    return _split_of(at, groups, train, val, rows.columns)


def _split_of(rows: DataFrame, groups: DataFrame, train: float, val: float, keep=("grp", "first_day")) -> DataFrame:
    """``rows(grp, first_day)`` with their ``split``; ``groups`` has each group once.

    Counts by day say on which day each share ends; only that day's groups are put in order.
    """
    if not (0 < train < 1 and 0 <= val < 1 and train + val < 1):
        raise ValueError("shares must leave something for the test split")
    dated = groups.where("first_day is not null")
    days = checkpointed(positioned(dated.groupBy("first_day").agg(F.count("*").alias("n")), ["first_day"], {"upto": F.col("n")}))
    n = days.agg(F.max("upto")).first()[0] or 0
    split = F.lit("test")
    for share, name in ((train + val, "val"), (train, "train")):
        most = int(n * share)
        end = days.where(F.col("upto") >= most).orderBy("first_day").limit(1).first() if most else None
        if end is None:
            continue
        # the last group of the share: the n-th by name among those of its day
        nth = most - (end.upto - end.n)
        last = positioned(dated.where(F.col("first_day") == end.first_day).select("grp"), ["grp"]).where(F.col("position") == nth).first().grp
        day, before = F.lit(end.first_day), F.col("grp").isNull() if last is None else F.col("grp").isNull() | (F.col("grp") <= F.lit(last))
        split = F.when((F.col("first_day") < day) | ((F.col("first_day") == day) & before), name).otherwise(split)
    return rows.select(*keep, F.when(F.col("first_day").isNull(), "train").otherwise(split).alias("split"))


def split_overlap(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups in more than one split; a sound split gives no rows."""
    return rows.groupBy(F.col(group).alias("grp")).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def incumbent(rows: DataFrame, group: str = "match_id", method: str = "method", order: str = "place") -> DataFrame:
    """How each match was made before: ``MANUAL`` if any of its rows was, else the method of its first row."""
    by = rows.groupBy(F.col(group).alias("match_id")).agg(F.max(F.col(method) == "MANUAL").alias("by_hand"), F.min_by(method, order).alias("first"))
    return by.select("match_id", F.when(F.col("by_hand"), "MANUAL").otherwise(F.col("first")).alias("rule"))
