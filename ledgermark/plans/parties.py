"""Queries about who paid: names, aliases, references and history, over parties derived from customers, orders and lines.

Names are letters made from a customer's number; orders write them as they are, with legal
forms and capitals, with a letter lost or added, as a trade name, as an identifier alone, as
somebody unknown, or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.operators import clusters, history, identity, ranges
from ledgermark.plans.fixture import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _letters(x: Column) -> Column:
    return F.translate(F.md5(x.cast("string")), "0123456789", "ghijklmnop")


def _name(key: Column) -> Column:
    # one customer in 97 has the name of the one before
    m = _letters(key - (key % 97 == 5).cast("int"))
    return F.concat_ws(" ", F.substr(m, F.lit(1), F.lit(7)), F.substr(m, F.lit(8), F.lit(8)), F.substr(m, F.lit(16), F.lit(5)))


def _trade(key: Column) -> Column:
    return F.concat(F.lit("T "), F.substr(_letters(key), F.lit(21), F.lit(11)), F.lit(" House"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("entity_id"), F.concat(_name(k), F.lit(" Ltd")).alias("canonical_name"), F.when(k % 3 == 0, F.concat(F.lit("G"), k)).alias("identifier"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    evidence = F.get(F.array(*[F.lit(e) for e in ("human", "cooccurrence", "llm", "gstin", "cooccurrence")]), (k % 5).cast("int"))
    sure = F.when(k % 5 == 1, k % 6).when(k % 5 == 4, 3).otherwise(5)
    return table(spark, sf_dir, "customer").select(_trade(k).alias("alias"), k.alias("entity_id"), evidence.alias("evidence"), sure.alias("confirmations"), F.when(k % 5 == 3, k % 2).otherwise(0).alias("contradictions"))


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    name = _name(k)
    forms = [F.concat(name, F.lit(" Ltd")), F.concat(F.upper(name), F.lit(", Pvt. Ltd.")), F.concat(F.left(name, F.lit(4)), F.substring(name, 6, 99)), F.concat(F.left(name, F.lit(3)), F.lit("x"), F.substring(name, 4, 99)), _trade(k), F.lit("unknown payer"), _letters(F.concat(F.lit("u"), o)), F.lit(None).cast("string")]
    return table(spark, sf_dir, "orders").select(F.get(F.array(*forms), (o % 8).cast("int")).alias("name"), F.when(o % 8 == 5, F.concat(F.lit("G"), k)).alias("identifier"))


_FORMS = ", ".join(f"'{w}'" for w in identity.FORMS)
_PARTIES = f"""WITH keyed AS (SELECT c_custkey AS k, translate(md5(CAST(c_custkey - CASE WHEN c_custkey % 97 = 5 THEN 1 ELSE 0 END AS VARCHAR)), '0123456789', 'ghijklmnop') AS m,
  'T ' || substr(translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789', 'ghijklmnop'), 21, 11) || ' House' AS trade FROM customer),
named AS (SELECT *, substr(m, 1, 7) || ' ' || substr(m, 8, 8) || ' ' || substr(m, 16, 5) AS base FROM keyed),
party AS (SELECT DISTINCT CASE o_orderkey % 8 WHEN 0 THEN base || ' Ltd' WHEN 1 THEN upper(base) || ', Pvt. Ltd.' WHEN 2 THEN left(base, 4) || substr(base, 6) WHEN 3 THEN left(base, 3) || 'x' || substr(base, 4)
    WHEN 4 THEN trade WHEN 5 THEN 'unknown payer' WHEN 6 THEN translate(md5('u' || o_orderkey), '0123456789', 'ghijklmnop') END AS name,
  CASE WHEN o_orderkey % 8 = 5 THEN 'G' || k END AS identifier FROM orders JOIN named ON k = o_custkey),
normed AS MATERIALIZED (SELECT *, array_to_string([w FOR w IN string_split(trim(regexp_replace(replace(lower(coalesce(name, '')), '.', ''), '[^a-z0-9]+', ' ', 'g')), ' ') IF w NOT IN ({_FORMS})], ' ') AS norm FROM party),
same AS (SELECT base AS norm, CASE WHEN min(k) = max(k) THEN min(k) END AS entity_id FROM named GROUP BY base),
gone AS (SELECT DISTINCT norm FROM normed n WHERE norm <> '' AND NOT EXISTS (SELECT 1 FROM same WHERE same.norm = n.norm)),
g1 AS (SELECT DISTINCT norm, substr(' ' || norm || ' ', i, 3) AS g FROM gone, range(1, length(norm) + 1) t(i)),
g2 AS (SELECT DISTINCT norm, substr(' ' || norm || ' ', i, 3) AS g FROM same, range(1, length(norm) + 1) t(i)),
n1 AS (SELECT norm, count(*) AS n FROM g1 GROUP BY norm), n2 AS (SELECT norm, count(*) AS n FROM g2 GROUP BY norm),
met AS (SELECT a.norm, b.norm AS r, count(*) AS c FROM g1 a JOIN g2 b USING (g) GROUP BY ALL),
sims AS (SELECT met.norm, r, c / (n1.n + n2.n - c) AS similarity FROM met JOIN n1 ON n1.norm = met.norm JOIN n2 ON n2.norm = r),
fuzzy AS (SELECT s.norm, max(similarity) AS similarity, CASE WHEN min(k) = max(k) THEN min(k) END AS entity_id FROM sims s JOIN named ON base = r
  WHERE similarity >= 0.6 AND similarity = (SELECT max(similarity) FROM sims t WHERE t.norm = s.norm) GROUP BY s.norm),
known AS (SELECT lower(replace(trade, 'T ', 't ')) AS norm, k AS entity_id FROM keyed WHERE CASE k % 5 WHEN 0 THEN true WHEN 1 THEN k % 6 >= 3 WHEN 2 THEN false WHEN 3 THEN k % 2 = 0 ELSE true END)
"""


query(
    "party_identity",
    _PARTIES + """SELECT n.name, n.identifier, CASE WHEN i.k IS NOT NULL THEN i.k WHEN same.norm IS NOT NULL THEN same.entity_id WHEN fuzzy.norm IS NOT NULL THEN fuzzy.entity_id ELSE known.entity_id END AS entity_id,
  CASE WHEN i.k IS NOT NULL THEN 'identifier' WHEN same.norm IS NOT NULL THEN CASE WHEN same.entity_id IS NULL THEN 'ambiguous' ELSE 'exact' END
       WHEN fuzzy.norm IS NOT NULL THEN CASE WHEN fuzzy.entity_id IS NULL THEN 'ambiguous' ELSE 'fuzzy' END WHEN known.norm IS NOT NULL THEN 'alias' ELSE 'none' END AS layer,
  CASE WHEN i.k IS NULL AND same.norm IS NULL THEN fuzzy.similarity END AS similarity
FROM normed n LEFT JOIN keyed i ON n.identifier = 'G' || i.k AND i.k % 3 = 0 LEFT JOIN same USING (norm) LEFT JOIN fuzzy USING (norm) LEFT JOIN known USING (norm)""",
)(lambda spark, sf_dir: identity.resolve(parties(spark, sf_dir), entities(spark, sf_dir), aliases(spark, sf_dir)))

# aliases between customers of neighbouring numbers; every eleventh was said by a person


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    names = at.select(F.col("c_name").alias("name"), F.when(k % 4 == 1, F.concat(F.lit("G"), F.floor(k / 8))).alias("identifier"))
    nexts = at.select((k - 1).alias("c_custkey"), F.col("c_name").alias("b"))
    edges = at.join(nexts, "c_custkey").select(F.col("c_name").alias("a"), "b", (k * 7919 % 1000 / F.lit(1000.0)).alias("weight"), F.when(k % 11 == 0, "human").otherwise("cooccurrence").alias("evidence"))
    return clusters.clustered(names, edges, merge=0.2, most=12)


_CLUSTERS = """WITH n AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 4 = 1 THEN 'G' || c_custkey // 8 END AS identifier FROM customer),
e AS (SELECT n.*, m.name AS b, n.k * 7919 % 1000 / 1000.0::DOUBLE AS weight, CASE WHEN n.k % 11 = 0 THEN 'human' ELSE 'cooccurrence' END AS evidence, n.k % 11 = 0 OR n.k * 7919 % 1000 >= 200 AS strong
      FROM n LEFT JOIN n m ON m.k = n.k + 1),
c AS (SELECT *, count(*) FILTER (NOT coalesce(was, false)) OVER (ORDER BY k) AS comp FROM (SELECT *, lag(strong AND b IS NOT NULL) OVER (ORDER BY k) AS was FROM e)),
s AS (SELECT *, count(*) OVER (PARTITION BY comp) > 12 AS over_, b IS NOT NULL AND strong AS joins,
        last_value(identifier IGNORE NULLS) OVER (PARTITION BY comp ORDER BY k) AS before, first_value(identifier IGNORE NULLS) OVER (PARTITION BY comp ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
        count(identifier) OVER (PARTITION BY comp ORDER BY k) AS part FROM c),
f AS (SELECT *, joins AND NOT over_ AND before <> after AND row_number() OVER (PARTITION BY comp, part, joins ORDER BY evidence = 'human', weight, name DESC) = 1 AS flagged FROM s),
p AS (SELECT *, count(*) FILTER (NOT coalesce(was2, false)) OVER (ORDER BY k) AS piece FROM (SELECT *, lag(joins AND NOT over_ AND NOT coalesce(flagged, false)) OVER (ORDER BY k) AS was2 FROM f)),
q AS (SELECT *, min(name) OVER (PARTITION BY piece) AS cluster, count(*) OVER (PARTITION BY piece) AS size FROM p)
"""
query("alias_clusters", _CLUSTERS + "SELECT name, identifier, cluster, CASE WHEN over_ THEN 'oversized' WHEN size > 1 THEN 'clustered' ELSE 'single' END AS state FROM q")(lambda spark, sf_dir: _clusters(spark, sf_dir)[0])
query(
    "alias_edges",
    _CLUSTERS + """SELECT name AS a, b, weight, evidence, CASE WHEN joins AND NOT over_ AND NOT coalesce(flagged, false) THEN cluster END AS cluster,
  CASE WHEN NOT strong THEN 'weak' WHEN over_ THEN 'oversized' WHEN coalesce(flagged, false) THEN 'flagged' ELSE 'merged' END AS status FROM q WHERE b IS NOT NULL""",
)(lambda spark, sf_dir: _clusters(spark, sf_dir)[1])

# orders as records that name the orders they pay, some of them very many


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    hi = (k + F.when(k % 1000 == 7, 20000).otherwise(k * 31 % 50)).cast("string")
    short = F.right(hi, F.lit(2))
    fits = (F.length(hi) > 2) & (F.length(hi) == F.length(k.cast("string"))) & (F.left(hi, F.length(hi) - 2) == F.left(k.cast("string"), F.length(hi) - 2)) & (k % 3 > 0)
    said = F.when(k % 10 == 9, None).when(k % 10 == 8, F.concat(F.lit("INV"), k, F.lit("-0 net"))).otherwise(F.concat(F.lit("paid INV"), k, F.lit("-"), F.when(fits, short).otherwise(hi), F.lit(" and INV"), k + 100, F.lit(".")))
    return table(spark, sf_dir, "orders").select(k.alias("record_id"), said.alias("text"))


query(
    "reference_ranges",
    """WITH r AS (SELECT o_orderkey AS record_id, o_orderkey AS lo, CASE WHEN o_orderkey % 10 = 8 THEN o_orderkey WHEN o_orderkey % 1000 = 7 THEN o_orderkey + 20000 ELSE o_orderkey + o_orderkey * 31 % 50 END AS hi FROM orders WHERE o_orderkey % 10 <> 9
  UNION ALL SELECT o_orderkey, o_orderkey + 100, o_orderkey + 100 FROM orders WHERE o_orderkey % 10 < 8)
SELECT record_id, count(*) AS n_invoices, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_minor FROM r JOIN orders ON o_orderkey BETWEEN lo AND hi GROUP BY record_id""",
)(
    lambda spark, sf_dir: ranges.in_ranges(
        _references(spark, sf_dir).select("record_id", F.inline(ranges.references(F.col("text")))), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice"), F.round(F.col("o_totalprice") * 100).cast("long").alias("minor")), "invoice"
    ).groupBy("record_id").agg(F.count("*").alias("n_invoices"), F.sum("minor").alias("total_minor"))
)

# history of payers: lines by the customer of their order


def _paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.col("l_shipdate").cast("date")
    return at.select(F.col("o_custkey").alias("payer"), day.alias("day"), F.datediff(day, F.col("o_orderdate").cast("date")).alias("lag_days"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_minor"), F.round(F.col("l_discount") * 10000).cast("long").alias("deduction_bps"), (F.col("l_linenumber") > 1).alias("is_mult"), F.col("l_suppkey").alias("key"))


_PAID = """WITH r AS (SELECT o_custkey AS payer, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag, CAST(round(l_extendedprice * 100) AS BIGINT) AS minor, CAST(round(l_discount * 10000) AS BIGINT) AS bps, l_linenumber > 1 AS mult, l_suppkey AS key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
query(
    "payer_history",
    _PAID + """SELECT payer, count(*) AS n_records, quantile_disc(lag, 0.5) AS median_lag_days, quantile_disc(lag, 0.9) AS p90_lag_days, CAST(round(avg(bps)) AS BIGINT) AS usual_deduction_bps,
  CASE WHEN avg(bps) <> 0 THEN round(1 - stddev_pop(bps) / avg(bps), 6) END AS deduction_stability, round(count(*) FILTER (mult) / count(*), 6) AS mult_rate, quantile_disc(minor, 0.5) AS median_amount FROM r GROUP BY payer""",
)(lambda spark, sf_dir: history.history(history.rolled(history.daily(_paid(spark, sf_dir)), ["payer"])))
query(
    "payer_top_keys",
    _PAID + """SELECT payer, string_agg(CAST(key AS VARCHAR), ',' ORDER BY r) AS top_keys FROM (SELECT payer, key, row_number() OVER (PARTITION BY payer ORDER BY n DESC, key) AS r FROM (SELECT payer, key, count(*) AS n FROM r GROUP BY payer, key)) WHERE r <= 3 GROUP BY payer""",
)(lambda spark, sf_dir: history.top_keys(_paid(spark, sf_dir), "key").select("payer", F.array_join(F.transform("top_keys", lambda x: x.cast("string")), ",").alias("top_keys")))
