"""Settlements, and reports over decisions: queue, aging, overview, samples, loci."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed, positioned
from ledgermark.operators import learn

#: Days that part the buckets, and the shortest span worth aging.
AGES, LEAST_SPAN = (30, 60, 90), 60


def settlements(items: DataFrame) -> DataFrame:
    """``items(entity_id, settlement_id, credit, debit, currency, settled_at)`` -> one row a settlement with a positive net, missing figures being 0."""
    net = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    by = items.where("settlement_id is not null").groupBy("settlement_id").agg(F.sum(net).alias("net_minor"), F.count("*").alias("n_lines"), F.min("currency").alias("currency"), F.min("settled_at").alias("settled_at"), F.sort_array(F.collect_list("entity_id")).alias("entity_ids"))
    return by.where("net_minor > 0")


def pools(credits: DataFrame, payments: DataFrame, days: int = 2) -> DataFrame:
    """Payments of a credit's currency booked up to ``days`` before it: ``record_id, n_pool, pool_minor``."""
    a = credits.where("amount_minor > 0").select("record_id", "currency", F.explode(F.sequence(F.col("day") - days, F.col("day"))).alias("day"))
    b = payments.where("amount_minor > 0").groupBy("currency", "day").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("s"))
    return a.join(b, ["currency", "day"]).groupBy("record_id").agg(F.sum("n").alias("n_pool"), F.sum("s").alias("pool_minor"))


def by_size(solved: DataFrame, truth: DataFrame) -> DataFrame:
    """Solver results by the true number of parts; ``truth(record_id, truth)`` holds sorted keys. Rates mean something from 20 on."""
    at = solved.join(truth, "record_id").withColumn("true_size", F.size("truth").cast("long"))
    ok = F.col("status") == "solved"
    same = F.col("members") == F.array_join("truth", ",")
    out = at.groupBy("true_size").agg(F.count("*").alias("n"), F.count_if(ok & same).alias("recovered"), F.count_if(ok & ~same).alias("wrong"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("status").isin("infeasible", "too_large")).alias("unresolved"))
    return out.withColumn("meaningful", F.col("n") >= 20)


def queue(decisions: DataFrame) -> DataFrame:
    """What was not posted, largest first, with its share and the running share of the whole queue."""
    q = decisions.where("outcome <> 'posted'").select("record_id", F.abs("amount_minor").alias("value"))
    at = positioned(q, [F.col("value").desc(), "record_id"], {"upto": F.col("value")})
    total = at.agg(F.sum("value").alias("total"))
    return at.crossJoin(F.broadcast(total)).select("record_id", "value", F.round(F.col("value") / F.col("total"), 9).alias("share"), F.round(F.col("upto") / F.col("total"), 6).alias("cum_share"))  # one row


def aging(decisions: DataFrame) -> DataFrame:
    """Unresolved value by age against the latest unresolved day; nothing if all days span less than :data:`LEAST_SPAN`."""
    span = decisions.agg((F.max("day") - F.min("day")).alias("span"))
    left = decisions.where("outcome <> 'posted' and day is not null").select("day", F.abs("amount_minor").alias("value"))
    last = left.agg(F.max("day").alias("latest"))
    at = left.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(span)).where(F.col("span") >= LEAST_SPAN)  # one row each
    age = F.col("latest") - F.col("day")
    bucket = F.when(age < AGES[0], f"0-{AGES[0]} days").when(age < AGES[1], f"{AGES[0]}-{AGES[1]} days").when(age < AGES[2], f"{AGES[1]}-{AGES[2]} days").otherwise(f"{AGES[2]}+ days")
    return at.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def overview(decisions: DataFrame, top: int = 10) -> DataFrame:
    """Size of the queue, its value, largest and middle amount, and the share of the ``top`` largest."""
    q = checkpointed(decisions.where("outcome <> 'posted'").groupBy(F.abs("amount_minor").alias("a")).agg(F.count("*").alias("n")))
    up = positioned(q.where("a is not null"), ["a"], {"upto": F.col("n")})
    some = q.where("a is not null").orderBy(F.desc("a")).limit(top).select(F.explode(F.array_repeat("a", F.least("n", F.lit(top)).cast("int"))).alias("a"))
    largest = some.orderBy(F.desc("a")).limit(top).agg(F.sum("a").alias("top"))
    sums = q.agg(F.sum("n").alias("n_queue"), F.sum(F.col("a") * F.col("n")).alias("value"), F.max("a").alias("largest"), F.sum(F.when(F.col("a").isNull(), F.col("n")).otherwise(0)).alias("_none"))
    sums = sums.select(F.coalesce("n_queue", F.lit(0)).alias("n_queue"), "value", "largest", "_none")
    # missing amounts come first in this order
    middle = up.crossJoin(F.broadcast(sums)).where(F.col("upto") + F.col("_none") >= F.expr("n_queue div 2") + 1).agg(F.min("a").alias("middle"))
    rest = sums.crossJoin(middle).withColumn("middle", F.when(F.col("_none") < F.expr("n_queue div 2") + 1, F.col("middle")))  # one row each
    return rest.crossJoin(largest).select("n_queue", "value", "largest", F.round(F.col("top") / F.col("value"), 6).alias("top10_share"), "middle")


def even_sample(rows: DataFrame, order: str, want: int) -> DataFrame:
    """Rows at positions ``floor(i * n / want)``, from 0."""
    at = positioned(rows, [order]).withColumn("position", F.col("position") - 1)
    n = at.count()
    places = at.sparkSession.range(want).select(F.floor(F.col("id") * n / F.lit(float(want))).alias("position")).distinct()
    return at.join(F.broadcast(places), "position").select(*rows.columns, "position")


def loci(judged: DataFrame, cand: DataFrame | None = None, more: tuple = ()) -> DataFrame:
    """Decisions with their labels -> ``record_id, locus`` and the columns ``more``, as a reviewer who knows the label would attribute them.

    Without ``cand``, ``judged`` says itself whether the label is a candidate (``hit``).
    """
    at = judged
    if cand is not None:
        hit = cand.select("record_id", F.col("key").alias("label")).withColumn("hit", F.lit(True))
        at = judged.join(hit, ["record_id", "label"], "left")
    right = F.array("label")
    offered = F.when(F.col("hit"), right).otherwise(F.array().cast("array<string>"))
    # of the ranking only its first key is asked for, which is the decision's
    first = F.when(F.col("key").isNotNull(), F.array("key"))
    return at.select("record_id", *more, learn.locus(right, offered, first, F.col("outcome") == "posted", F.col("path") == "multiplicity", F.col("is_mult")).alias("locus"))


def retrieve_vectors(vectors: DataFrame, k: int = 5, least: float = 0.1) -> DataFrame:
    """Every 20th vector as a query against the other vectors of its label: the k most similar."""
    at = vectors.select("vec_id", F.col("label").alias("locus"), F.col("embedding").alias("situation"))
    found = learn.retrieve(at.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), at.withColumnRenamed("vec_id", "case_id").withColumn("retired", F.lit(False)), k, least, F.col("query_id") != F.col("case_id"))
    return found.select("query_id", "case_id", F.round("similarity", 6).alias("similarity"), "rank")


def arms(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Every arm of the learning simulation, one after the other."""
    out, at = None, learn.arrivals(decisions, truth)
    for arm in ("off", "corrections", "spot_check", "placebo", "shuffled"):
        rows = learn.simulated(at, arm=arm).withColumn("arm", F.lit(arm))
        out = rows if out is None else out.union(rows)
    return out


def verdicts(solved: DataFrame, truth: DataFrame, cand: DataFrame, cap: int = 64) -> DataFrame:
    """What to say of each answer; ``unreachable`` where the true parts were not all in the pool, or it was over the cap.

    The status comes first: an empty answer to an empty truth is no find.
    """
    held = cand.join(truth.select("record_id", F.explode("truth").alias("key")), ["record_id", "key"]).groupBy("record_id").agg(F.count_distinct("key").alias("held"))
    at = solved.join(truth, "record_id").join(held, "record_id", "left")
    found = F.col("members") == F.array_join("truth", ",")
    verdict = F.when((F.col("status") == "solved") & found, "found").when(F.col("status") == "solved", "wrong").when(F.col("status") == "ambiguous", "two fit").otherwise("unresolved")
    return at.select("record_id", verdict.alias("verdict"), ((F.coalesce("held", F.lit(0)) < F.size("truth")) | (F.col("n_pool") > cap)).alias("unreachable"))


def listing(solved: DataFrame, truth: DataFrame, cand: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` largest settlements with answer, true parts and verdict."""
    at = solved.orderBy(F.abs("target").desc(), "record_id").limit(top)
    said = verdicts(at, truth.join(at.select("record_id"), "record_id", "left_semi"), cand)
    return at.join(said, "record_id").join(truth, "record_id").select("record_id", "target", "n_pool", "status", F.coalesce("members", F.lit("")).alias("members"), F.array_join("truth", ",").alias("truth"), "verdict", "unreachable")


def rates(solved: DataFrame, truth: DataFrame, cand: DataFrame) -> DataFrame:
    """By the true number of parts: coverage (answered), precision of answers, share of wrong ones, and how many could not be reached."""
    said = verdicts(solved, truth, cand).join(truth.select("record_id", F.size("truth").cast("long").alias("true_size")), "record_id")
    found, wrong = (F.count_if(F.col("verdict") == v) for v in ("found", "wrong"))
    by = said.groupBy("true_size").agg(F.count("*").alias("n"), found.alias("found"), wrong.alias("wrong"), F.count_if("unreachable").alias("unreachable"))
    answered = F.col("found") + F.col("wrong")
    return by.select("true_size", "n", F.round(answered / F.col("n"), 6).alias("coverage"), F.round(F.try_divide("found", answered), 6).alias("precision"), F.round(F.col("wrong") / F.col("n"), 6).alias("wrong_rate"), "unreachable")


def near_events(events: DataFrame, first: str, second: str, days: int) -> DataFrame:
    """Pairs of two kinds of a user's events within some days: a band join by bins, counted per user."""
    width = days * 86_400
    at = events.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    bin_of = lambda us: F.floor(us / (width * 1_000_000)).cast("long")
    a = at.where(F.col("event_type") == first).select("user_id", F.col("us").alias("a"), F.explode(F.sequence(bin_of(F.col("us")) - 1, bin_of(F.col("us")) + 1)).alias("bin"))
    b = at.where(F.col("event_type") == second).select("user_id", F.col("us").alias("b"), bin_of(F.col("us")).alias("bin"))
    return a.join(b, ["user_id", "bin"]).where(F.abs(F.col("a") - F.col("b")) <= width * 1_000_000).groupBy("user_id").agg(F.count("*").alias("n"))
