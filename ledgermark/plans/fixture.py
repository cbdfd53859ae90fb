"""Bank and ledger derived from ``lineitem``, as DataFrames and as SQL.

Every modulus is a condition put in on purpose: null and orphan accounts, charges that
leave no exact amount, days outside the band, null days, credits that cover two or
three keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_minor"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("2000-01-01").cast("date")).alias("day"))
    rid = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount_minor", "day"))
    return at.select(F.concat(F.lit("K"), "l_orderkey").alias("key"), F.concat(F.lit("S"), "l_suppkey").alias("account"), "amount_minor", "day", "l_orderkey", "l_linenumber", rid.alias("rid"))


def bank(rows: DataFrame) -> DataFrame:
    """From :func:`ledger`'s rows."""
    k = F.col("l_orderkey")
    single = rows.where("l_linenumber = 1").select(
        F.concat(F.lit("b"), "rid").alias("record_id"),
        F.when(k % 50 == 7, None).when(k % 50 == 9, "S_NONE").otherwise(F.col("account")).alias("account"),
        F.when(k % 10 == 0, F.col("amount_minor") - 200).when(k % 20 == 3, F.col("amount_minor") - 137).otherwise(F.col("amount_minor")).alias("amount_minor"),
        F.when(k % 50 == 8, None).when(k % 20 == 3, F.col("day") + 9).otherwise((F.col("day") + k % 5).cast("int")).alias("day"),
        F.col("key").alias("label"), F.lit(False).alias("is_mult"), F.concat(F.lit("m"), k).alias("match_id"),
    )
    return single.union(groups(rows))


def groups(rows: DataFrame) -> DataFrame:
    """Credits that cover two or three keys of an account and day, each with one line."""
    k = F.col("l_orderkey")
    # of up to three order numbers the middle one is what the least and the greatest leave of their sum
    # hardly two lines of a task share an account and day, so they are dealt out as they are, without sums of parts
    by = rows.select("account", "day", "amount_minor", "l_orderkey").repartition("account", "day").groupBy("account", "day").agg(F.sum("amount_minor").alias("amount_minor"), F.count("*").alias("n"), F.count(k).alias("known"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.sum(k).alias("s")).where("n between 2 and 3 and known = n")
    middle = F.col("s") - F.col("lo") - F.col("hi")
    by = by.where((F.col("lo") < F.col("hi")) & ((F.col("n") == 2) | ((F.col("lo") < middle) & (middle < F.col("hi")))))
    name = F.concat_ws("_", "account", "day")
    return by.select(F.concat(F.lit("g"), name).alias("record_id"), "account", "amount_minor", (F.col("day") + 1).cast("int").alias("day"), F.lit("MULT").alias("label"), F.lit(True).alias("is_mult"), F.concat(F.lit("mg"), name).alias("match_id"))


def disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as corrections: ``seq, case_id, locus, situation``; amount, quantity, discount and tax make the situation."""
    at = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    case = F.concat(F.lit("c"), F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"))))
    parts = F.log10(F.greatest("l_extendedprice", F.lit(1.0))), F.col("l_quantity") / 10, F.col("l_discount") * 50, F.col("l_tax") * 60
    return at.select(F.col("l_orderkey").alias("seq"), case.alias("case_id"), F.concat("l_linestatus", "l_linenumber").alias("locus"), F.array(*[F.round(p, 6) for p in parts]).alias("situation"))


DISPUTES = """disputes AS MATERIALIZED (
  SELECT l_orderkey AS seq, 'c' || md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))) AS case_id, l_linestatus || l_linenumber AS locus,
    [round(x, 6) FOR x IN [log10(greatest(l_extendedprice, 1.0)), l_quantity / 10, l_discount * 50, l_tax * 60]]::DOUBLE[] AS v FROM lineitem WHERE l_returnflag = 'R')"""
LEDGER = """ledger AS (
  SELECT *, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, amount_minor, day)) AS rid FROM (
    SELECT 'K' || l_orderkey AS key, 'S' || l_suppkey AS account, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor,
           CAST(date_diff('day', DATE '2000-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day,
           l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))"""
BANK = """bank AS (
  SELECT 'b' || rid AS record_id,
         CASE WHEN l_orderkey % 50 = 7 THEN NULL WHEN l_orderkey % 50 = 9 THEN 'S_NONE' ELSE account END AS account,
         CASE WHEN l_orderkey % 10 = 0 THEN amount_minor - 200 WHEN l_orderkey % 20 = 3 THEN amount_minor - 137 ELSE amount_minor END AS amount_minor,
         CAST(CASE WHEN l_orderkey % 50 = 8 THEN NULL WHEN l_orderkey % 20 = 3 THEN day + 9 ELSE day + (l_orderkey % 5) END AS INTEGER) AS day,
         key AS label, false AS is_mult, 'm' || l_orderkey AS match_id
  FROM ledger WHERE l_linenumber = 1
  UNION ALL
  SELECT 'g' || account || '_' || day, account, CAST(sum(amount_minor) AS BIGINT), CAST(day + 1 AS INTEGER), 'MULT', true, 'mg' || account || '_' || day
  FROM ledger GROUP BY account, day HAVING count(DISTINCT key) BETWEEN 2 AND 3 AND count(*) = count(DISTINCT key))"""


def cand_sql(slack: int = 7, name: str = "cand") -> str:
    return f"""{name} AS (
  SELECT b.record_id, l.key FROM bank b JOIN ledger l ON b.account = l.account AND b.amount_minor = l.amount_minor
  UNION
  SELECT b.record_id, l.key FROM bank b JOIN ledger l ON b.account = l.account AND l.day BETWEEN b.day - {slack} AND b.day + {slack})"""


STATS = """stats AS (
  SELECT key, list_sort(list(DISTINCT amount_minor)) AS amounts, list_sort(list(DISTINCT day) FILTER (day IS NOT NULL)) AS days,
         count(*) AS n_rows, CAST(sum(DISTINCT amount_minor) AS BIGINT) AS total_minor FROM ledger GROUP BY key)"""
PAIRS = """p0 AS (
  SELECT c.record_id, c.key, b.account, b.amount_minor, b.day, b.label, b.is_mult, s.amounts, s.days, s.n_rows, s.total_minor,
         list_min([abs(a - b.amount_minor) FOR a IN s.amounts]) AS miss, list_min([abs(b.day - d) FOR d IN s.days]) AS gap,
         count(*) OVER (PARTITION BY c.record_id) AS n
  FROM cand c JOIN bank b USING (record_id) JOIN stats s USING (key)),
pairs AS (
  SELECT *, CASE WHEN list_contains(amounts, amount_minor) THEN 1.0::DOUBLE ELSE 0.0 END AS amount_exact, miss / 100.0::DOUBLE AS amount_delta_abs,
         CASE WHEN gap IS NULL THEN 999.0::DOUBLE ELSE gap::DOUBLE END AS date_gap_abs,
         CASE WHEN gap IS NULL THEN 0.0::DOUBLE ELSE (day - list_min([d FOR d IN days IF abs(p0.day - d) = gap]))::DOUBLE END AS date_gap_signed
  FROM p0)"""
SCORED = """scored AS (SELECT record_id, key, label, is_mult, 4.0::DOUBLE / (1.0 + amount_delta_abs) + 1.0::DOUBLE / (1.0 + date_gap_abs) AS score FROM pairs),
ranks AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, key) AS rank FROM scored),
ranked AS (SELECT record_id, count(*) AS n, max(CASE WHEN rank = 1 THEN key END) AS key, max(CASE WHEN rank = 1 THEN score END) AS score,
             max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS margin,
             string_agg(key, ',' ORDER BY rank) AS ranked_keys FROM ranks GROUP BY record_id)"""
DECIDED = """d0 AS (
  SELECT b.*, coalesce(c.n_blocked, 0) AS n_blocked, coalesce(r.n, 0) AS n_scored, coalesce(e.n_exact, 0) AS n_exact, r.key AS best, r.margin, r.ranked_keys,
         least(greatest(0.85 + 0.02 * log10(greatest(abs(b.amount_minor), 10000) / 10000.0::DOUBLE), 0.85), 0.995) AS threshold
  FROM bank b LEFT JOIN (SELECT record_id, count(*) AS n_blocked FROM cand GROUP BY 1) c USING (record_id)
  LEFT JOIN ranked r USING (record_id)
  LEFT JOIN (SELECT record_id, CAST(sum(amount_exact) AS BIGINT) AS n_exact FROM pairs GROUP BY 1) e USING (record_id)),
d1 AS (
  SELECT *, CASE WHEN n_blocked = 0 THEN 'blocked' WHEN n_scored = 0 THEN 'unscorable' WHEN n_exact = 0 THEN 'multiplicity'
                 WHEN n_scored >= 2 THEN 'ranked' WHEN n_exact = 1 THEN 'direct' ELSE 'lone' END AS p FROM d0),
d2 AS (SELECT *, CASE WHEN p = 'ranked' THEN 1.0 / (1.0 + exp(-margin)) WHEN p = 'direct' THEN 0.9898::DOUBLE END AS confidence FROM d1),
decided AS (
  SELECT record_id, account, amount_minor, day, label, is_mult, match_id, n_blocked, n_scored, n_exact, threshold, confidence, margin, ranked_keys,
         CASE WHEN p = 'lone' THEN 'ranked' ELSE p END AS path,
         CASE p WHEN 'blocked' THEN 'no_candidate' WHEN 'unscorable' THEN 'unscorable' WHEN 'multiplicity' THEN 'suspected_grouped'
                ELSE CASE WHEN confidence >= threshold THEN 'posted' ELSE 'queued' END END AS outcome,
         CASE WHEN p IN ('ranked', 'direct', 'lone') THEN best END AS key FROM d2)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = with_(LEDGER, BANK)
CAND = with_(LEDGER, BANK, cand_sql())
PAIRED = with_(LEDGER, BANK, cand_sql(), STATS, PAIRS)
RANKED = with_(LEDGER, BANK, cand_sql(), STATS, PAIRS, SCORED)
DECISIONS = with_(LEDGER, BANK, cand_sql(), STATS, PAIRS, SCORED, DECIDED)
