"""The query catalogue: each entry is a function of (spark, sf_dir) and, where SQL can say it, its SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermark.functions import dates, money, residual
from ledgermark.functions.gate import threshold
from ledgermark.functions.order import checkpointed, positioned, scratch_path
from ledgermark.functions.similarity import situation_vector
from ledgermark.operators import assign, audit, blocking, boost, cases, decide, evaluate, features, learn, models, narrate, patterns, rank, relearn, settle, solver
from ledgermark.plans import fixture as fx
from ledgermark.plans import parties
from ledgermark.plans.fixture import BANK, BASE, CAND, DECIDED, DECISIONS, LEDGER, PAIRED, PAIRS, RANKED, SCORED, STATS, table, with_
from ledgermark.sources import csv_files
from ledgermark.streaming import feed

#: Weights are up to 5; an assignment may miss the greatest total by so much for each record.
EPSILON = 0.05
#: Arrivals of a micro-batch, of which a task takes those of a locus.
ARRIVALS = 5_000_000
QUERIES: dict = dict(parties.QUERIES)
SQL: dict[str, str] = dict(parties.SQL)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


class View:
    """The fixture's tables and what follows from them, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.ledger = fx.ledger(spark, sf_dir)
        self.bank = fx.bank(self.ledger)
        self._records = self._by_name = self._groups = self._group_cand = None

    def groups(self) -> DataFrame:
        """The bank's grouped credits alone, written once, as they take a shuffle of the ledger."""
        if self._groups is None:
            self._groups = checkpointed(fx.groups(self.ledger).withColumn("number", F.monotonically_increasing_id()))
        return self._groups

    def group_cand(self) -> DataFrame:
        """Candidates of the grouped credits, found for these alone and by number, written once."""
        if self._group_cand is None:
            at = self.groups().select(F.col("number").alias("record_id"), "account", "amount_minor", "day")
            self._group_cand = checkpointed(blocking.candidates(at, self.ledger))
        return self._group_cand

    def records(self) -> DataFrame:
        """The bank with numbers for ids, written once: its groups take a shuffle of the ledger."""
        if self._records is None:
            self._records = features.numbered(self.bank)
        return self._records

    def cand(self, slack: int = 7) -> DataFrame:
        return blocking.candidates(self.bank, self.ledger, slack)

    def stats(self) -> DataFrame:
        return features.key_stats(self.ledger)

    def pairs(self) -> DataFrame:
        return self.brief_pairs().withColumn("record_id", F.col("name")).drop("name")

    def brief_pairs(self, records: DataFrame | None = None) -> DataFrame:
        """Pairs with numbers as record ids, dealt out by them."""
        records = self.records() if records is None else records
        return features.pairs(blocking.found(records, self.ledger, 7, ("amount_minor", "day")), records, self.stats())

    def scored(self) -> DataFrame:
        return rank.rules_score(self.pairs())

    def features(self) -> DataFrame:
        """What a decision needs of each record; one pass over the pairs gives counts, exact hits and ranking."""
        return decide.looked_up(self.records(), self.ledger, self.stats())

    def decisions(self) -> DataFrame:
        return decide.decided(self.features())

    def judged(self) -> DataFrame:
        return decide.decided(self.features(), keep=("label", "is_mult", "match_id", "hit"))


def v(f):
    return lambda spark, sf_dir: f(View(spark, sf_dir))


# blocking

query("block_amount", BASE + "SELECT DISTINCT b.record_id, l.key FROM bank b JOIN ledger l ON b.account = l.account AND b.amount_minor = l.amount_minor")(v(lambda x: blocking.candidates(x.bank, x.ledger, use_date=False)))
query("block_date", BASE + "SELECT DISTINCT b.record_id, l.key FROM bank b JOIN ledger l ON b.account = l.account AND l.day BETWEEN b.day - 7 AND b.day + 7")(v(lambda x: blocking.candidates(x.bank, x.ledger, use_amount=False)))
query("block_union", CAND + "SELECT * FROM cand")(v(lambda x: x.cand()))
query(
    "block_sweep",
    BASE + ", n AS (SELECT count(*) AS n FROM bank WHERE NOT is_mult), " + ", ".join(f"c{s} AS (SELECT DISTINCT b.record_id, l.key, b.label, b.is_mult FROM bank b JOIN ledger l ON b.account = l.account AND (b.amount_minor = l.amount_minor OR coalesce(l.day BETWEEN b.day - {s} AND b.day + {s}, false)))" for s in (0, 1, 2, 3, 7, 14))
    + ", ca AS (SELECT DISTINCT b.record_id, l.key, b.label, b.is_mult FROM bank b JOIN ledger l ON b.account = l.account AND b.amount_minor = l.amount_minor)"
    + " UNION ALL ".join(f"SELECT '{'amount' if s == 'a' else f'date_{s}'}' AS strategy, count(*) AS pairs, count(*) FILTER (key = label AND NOT is_mult) AS hits, round(count(*) FILTER (key = label AND NOT is_mult) / max(n.n)::DOUBLE, 6) AS recall FROM c{s}, n" for s in ("a", 0, 1, 2, 3, 7, 14)),
)(v(lambda x: blocking.sweep(x.bank, x.ledger)))
query("blocked_nothing", CAND + "SELECT record_id, account, amount_minor, day FROM bank WHERE record_id NOT IN (SELECT record_id FROM cand)")(v(lambda x: blocking.unmatched(x.bank, x.cand()).select("record_id", "account", "amount_minor", "day")))
query("unscorable", CAND + "SELECT DISTINCT record_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand d JOIN ledger l ON d.key = l.key AND l.l_linenumber = 1 WHERE d.record_id = c.record_id)")(
    v(lambda x: (lambda c: c.select("record_id").distinct().join(c.join(x.ledger.where("l_linenumber = 1").select("key").distinct(), "key", "left_semi"), "record_id", "left_anti"))(x.cand()))
)
query("exact_hits", PAIRED + "SELECT record_id, CAST(sum(amount_exact) AS BIGINT) AS n_exact, count(*) AS n_candidates, CAST(min(miss) AS BIGINT) AS min_delta FROM pairs GROUP BY 1")(
    v(lambda x: x.pairs().groupBy("record_id").agg(F.sum("amount_exact").cast("long").alias("n_exact"), F.count("*").alias("n_candidates"), F.min("miss").alias("min_delta")))
)
query("lone_exact", PAIRED + "SELECT record_id, max(CASE WHEN amount_exact = 1 THEN key END) AS key FROM pairs GROUP BY 1 HAVING sum(amount_exact) = 1")(
    v(lambda x: x.pairs().groupBy("record_id").agg(F.sum("amount_exact").alias("n"), F.max(F.when(F.col("amount_exact") == 1, F.col("key"))).alias("key")).where("n = 1").select("record_id", "key"))
)

# keys, features

query("key_stats", with_(LEDGER, fx.STATS) + "SELECT key, array_to_string(amounts, ',') AS amounts, array_to_string(days, ',') AS days, n_rows, total_minor FROM stats")(
    v(lambda x: x.stats().select("key", F.array_join("amounts", ",").alias("amounts"), F.array_join("days", ",").alias("days"), "n_rows", "total_minor"))
)
query("n_keys", with_(LEDGER) + "SELECT count(DISTINCT key) AS n_keys, count(DISTINCT account) AS n_accounts, count(*) AS n_rows FROM ledger")(v(lambda x: x.ledger.agg(F.count_distinct("key").alias("n_keys"), F.count_distinct("account").alias("n_accounts"), F.count("*").alias("n_rows"))))
_SCALE = "(greatest(abs(amount_minor), 1) / 100.0::DOUBLE)"
query(
    "pair_features",
    PAIRED + f"""SELECT record_id, key, amount_exact, round(amount_delta_abs, 6) AS amount_delta_abs, round(least(amount_delta_abs / {_SCALE}, 1e6), 6) AS amount_delta_rel,
      round(abs(amount_minor - total_minor) / 100.0::DOUBLE, 6) AS total_delta_abs, round(least(abs(amount_minor - total_minor) / 100.0::DOUBLE / {_SCALE}, 1e6), 6) AS total_delta_rel,
      date_gap_abs, date_gap_signed, CASE WHEN gap IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS date_missing, n_rows::DOUBLE AS key_n_rows,
      CASE WHEN n_rows = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS key_is_single_row, round(total_minor / 100.0::DOUBLE, 6) AS key_total_major, n::DOUBLE AS n_candidates FROM pairs""",
)(v(lambda x: x.pairs().select("record_id", "key", *[F.round(c, 6).alias(c) if c not in ("amount_exact", "date_gap_abs", "date_gap_signed", "date_missing", "key_n_rows", "key_is_single_row", "n_candidates") else F.col(c) for c in features.PAIR])))
_PRIOR = "prior AS (SELECT account, median(abs(amount_minor))::DOUBLE AS median_abs, avg(is_mult::INT) AS mult_rate FROM bank WHERE account IS NOT NULL GROUP BY 1), globally AS (SELECT median(abs(amount_minor))::DOUBLE AS m, avg(is_mult::INT) AS r FROM bank)"
query("account_prior", BASE.rstrip() + f", {_PRIOR} SELECT account, round(median_abs, 6) AS median_abs, round(mult_rate, 6) AS mult_rate FROM prior")(
    v(lambda x: features.account_prior(x.bank)[0].select("account", F.round("median_abs", 6).alias("median_abs"), F.round("mult_rate", 6).alias("mult_rate")))
)
query(
    "mult_features",
    PAIRED.rstrip() + f""", {_PRIOR}, a AS (SELECT record_id, count(*) AS n, max(amount_exact) AS ex, min(miss) AS miss FROM pairs GROUP BY 1)
      SELECT b.record_id, coalesce(ex, 0.0)::DOUBLE AS has_exact, coalesce(n, 0)::DOUBLE AS n_candidates, round(log10(abs(amount_minor) + 1.0::DOUBLE), 6) AS log_amount,
        round(abs(amount_minor) / CASE WHEN median_abs = 0 THEN 1.0 ELSE coalesce(median_abs, g.m) END, 6) AS amount_over_median, round(coalesce(mult_rate, g.r), 6) AS mult_rate,
        round(least(coalesce(miss::DOUBLE, 1e12) / 100, 1e12), 6) AS min_delta, round(least(coalesce(miss::DOUBLE, 1e12) / greatest(abs(amount_minor), 1), 1e6), 6) AS min_delta_rel
      FROM bank b CROSS JOIN globally g LEFT JOIN a USING (record_id) LEFT JOIN prior USING (account)""",
)(v(lambda x: features.mult_features(x.bank, x.pairs(), features.account_prior(x.bank)).select("record_id", "has_exact", "n_candidates", *[F.round(c, 6).alias(c) for c in features.MULT[2:]])))

# ranking, gate, decisions

query("rules_rank", PAIRED + "SELECT record_id, key, CAST(1 - amount_exact AS INTEGER) AS amount_missed, CAST(date_gap_abs AS INTEGER) AS gap FROM pairs QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY 1 - amount_exact, date_gap_abs, key) = 1")(v(lambda x: rank.rules_best(x.pairs())))
query("rules_margin", RANKED + "SELECT record_id, n, key, round(score, 6) AS score, round(margin, 6) AS margin FROM ranked")(v(lambda x: rank.ranked(x.scored()).select("record_id", "n", "key", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))))
query("ranked_keys", RANKED + "SELECT record_id, ranked_keys FROM ranked")(v(lambda x: rank.ranked(x.scored()).select("record_id", F.array_join("ranked_keys", ",").alias("ranked_keys"))))
query("gate_threshold", BASE + "SELECT record_id, round(least(greatest(0.85 + 0.02 * log10(greatest(abs(amount_minor), 10000) / 10000.0::DOUBLE), 0.85), 0.995), 9) AS threshold FROM bank")(v(lambda x: x.bank.select("record_id", F.round(threshold(F.col("amount_minor")), 9).alias("threshold"))))
query("decisions", DECISIONS + "SELECT record_id, outcome, path, key, round(confidence, 6) AS confidence, round(threshold, 6) AS threshold, n_blocked, n_scored, n_exact FROM decided")(
    v(lambda x: x.decisions().select("record_id", "outcome", "path", "key", F.round("confidence", 6).alias("confidence"), F.round("threshold", 6).alias("threshold"), F.col("n_blocked").cast("long").alias("n_blocked"), F.col("n_scored").cast("long").alias("n_scored"), F.col("n_exact").cast("long").alias("n_exact")))
)
query("outcome_summary", DECISIONS + "SELECT outcome, path, count(*) AS n FROM decided GROUP BY ALL")(v(lambda x: x.decisions().groupBy("outcome", "path").agg(F.count("*").alias("n"))))
query("value_by_outcome", DECISIONS + "SELECT outcome, count(*) AS n, CAST(sum(abs(amount_minor)) AS BIGINT) AS value_minor FROM decided GROUP BY 1")(v(lambda x: x.decisions().groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.abs("amount_minor")).alias("value_minor"))))
query("straight_through", DECISIONS + "SELECT count(*) AS n, count(*) FILTER (outcome = 'posted') AS posted, round(count(*) FILTER (outcome = 'posted') / count(*)::DOUBLE, 6) AS rate, round(count(*) FILTER (outcome = 'posted' AND key = label) / nullif(count(*) FILTER (outcome = 'posted'), 0)::DOUBLE, 6) AS precision FROM decided")(
    v(lambda x: x.judged().agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "posted").alias("posted"), F.count_if((F.col("outcome") == "posted") & (F.col("key") == F.col("label"))).alias("right")).select("n", "posted", F.round(F.col("posted") / F.col("n"), 6).alias("rate"), F.round(F.try_divide("right", "posted"), 6).alias("precision")))
)
query("exception_taxonomy", DECISIONS + "SELECT CASE WHEN path IN ('ranked', 'direct') AND confidence IS NULL THEN 'no_support' WHEN path IN ('ranked', 'direct') THEN 'below_threshold' ELSE path END AS reason, count(*) AS n FROM decided WHERE outcome <> 'posted' GROUP BY 1")(
    v(lambda x: x.decisions().where("outcome <> 'posted'").groupBy(F.when(F.col("path").isin("ranked", "direct"), F.when(F.col("confidence").isNull(), "no_support").otherwise("below_threshold")).otherwise(F.col("path")).alias("reason")).agg(F.count("*").alias("n")))
)

@query(
    "decisions_unknown_keys",
    with_(LEDGER, BANK, fx.cand_sql(), STATS.replace("FROM ledger GROUP BY key", "FROM ledger WHERE l_orderkey % 3 = 0 GROUP BY key"), PAIRS, SCORED, DECIDED) + "SELECT outcome, path, count(*) AS n, CAST(sum(n_blocked) AS BIGINT) AS n_blocked, CAST(sum(n_scored) AS BIGINT) AS n_scored FROM decided GROUP BY ALL",
)
def decisions_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes where the statistics of two keys in three are not there, so that some records are unscorable."""
    x = View(spark, sf_dir)
    x.stats = lambda: features.key_stats(x.ledger.where("l_orderkey % 3 = 0"))
    return x.decisions().groupBy("outcome", "path").agg(F.count("*").alias("n"), F.sum("n_blocked").alias("n_blocked"), F.sum("n_scored").alias("n_scored"))


@query(
    "assignment_check",
    PAIRED + "SELECT count(DISTINCT record_id) FILTER (NOT is_mult) AS records, count(DISTINCT key) FILTER (NOT is_mult) AS keys, CAST(0 AS BIGINT) AS record_twice, CAST(0 AS BIGINT) AS key_twice, CAST(0 AS BIGINT) AS worse_than_greedy FROM pairs",
)
def assignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an assignment must hold: no record and no key twice, and no less weight, but for the bound, than records taking keys in turn of their best pair."""
    x = View(spark, sf_dir)
    edges = checkpointed(_numbered_edges(x))
    got = checkpointed(assign.assign(edges, EPSILON))
    mutual = edges.withColumn("a", F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("weight").desc(), "key"))).where("a = 1")
    mutual = mutual.withColumn("b", F.row_number().over(Window.partitionBy("key").orderBy(F.col("weight").desc(), "record_id"))).where("b = 1")
    least = mutual.agg(F.sum("weight").alias("least"))
    totals = got.agg(F.sum("weight").alias("w"), F.count("*").alias("n"), (F.count("*") - F.count_distinct("record_id")).alias("record_twice"), (F.count("*") - F.count_distinct("key")).alias("key_twice"))
    size = edges.agg(F.count_distinct("record_id").alias("records"), F.count_distinct("key").alias("keys"))
    return size.crossJoin(totals).crossJoin(least).select("records", "keys", "record_twice", "key_twice", (F.col("w") + EPSILON * F.col("n") < F.col("least")).cast("long").alias("worse_than_greedy"))


def _records_by_name(x: View) -> DataFrame:
    """Records of single keys with numbers in the order of their names, so that ties fall as by name; written once."""
    if x._by_name is None:
        at = x.records().where("not is_mult")
        numbers = positioned(at.select("name").distinct(), ["name"]).withColumnRenamed("position", "number")
        x._by_name = checkpointed(at.join(numbers, "name").withColumn("record_id", F.col("number")).drop("number"))
    return x._by_name


def _numbered_edges(x: View) -> DataFrame:
    return x.brief_pairs(_records_by_name(x)).select("record_id", "key", F.round(rank.closeness(), 6).alias("weight"))


def _named(x: View, rows: DataFrame) -> DataFrame:
    names = _records_by_name(x).select("record_id", "name").distinct()
    return rows.join(names, "record_id").withColumn("record_id", F.col("name")).drop("name")


query("assignment")(v(lambda x: _named(x, assign.assign(_numbered_edges(x), EPSILON))))

_PATTERNED = "SELECT 'status=' || l_linestatus AS a, 'supplier=S' || l_suppkey AS b, 'size=' || CASE WHEN l_extendedprice < 20000 THEN 'small' WHEN l_extendedprice < 60000 THEN 'medium' ELSE 'large' END AS c, 'discount=' || CAST(round(l_discount * 100) AS INTEGER) AS d, CAST(round(l_extendedprice * 100) AS BIGINT) AS m FROM lineitem WHERE l_returnflag = 'R'"
_PATTERNS = f"""WITH f AS ({_PATTERNED}), i AS (SELECT a AS pattern, m FROM f UNION ALL SELECT b, m FROM f UNION ALL SELECT c, m FROM f UNION ALL SELECT d, m FROM f),
  j AS (SELECT a || ' & ' || b AS pattern, m FROM f UNION ALL SELECT a || ' & ' || c, m FROM f UNION ALL SELECT a || ' & ' || d, m FROM f UNION ALL SELECT b || ' & ' || c, m FROM f UNION ALL SELECT b || ' & ' || d, m FROM f UNION ALL SELECT c || ' & ' || d, m FROM f),
  p AS (SELECT pattern, 1 AS size, count(*) AS n, CAST(sum(m) AS BIGINT) AS impact FROM i GROUP BY 1 HAVING count(*) >= 10 UNION ALL SELECT pattern, 2, count(*), CAST(sum(m) AS BIGINT) FROM j GROUP BY 1 HAVING count(*) >= 10)
  """


def _patterns(x: View) -> DataFrame:
    at = table(x.spark, x.sf_dir, "lineitem").where("l_returnflag = 'R'")
    size = F.when(F.col("l_extendedprice") < 20000, "small").when(F.col("l_extendedprice") < 60000, "medium").otherwise("large")
    at = at.select(F.col("l_linestatus").alias("status"), F.concat(F.lit("S"), "l_suppkey").alias("supplier"), size.alias("size"), F.round(F.col("l_discount") * 100).cast("int").alias("discount"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"))
    return patterns.frequent(at, ["status", "supplier", "size", "discount"], "amount")


query("correction_patterns", _PATTERNS + "SELECT * FROM p")(v(_patterns))
query("proposed_rules", _PATTERNS + "SELECT split_part(x.pattern, ' & ', 1) AS condition, split_part(x.pattern, ' & ', 2) AS outcome, x.n, x.impact, round(x.n / y.n::DOUBLE, 6) AS confidence FROM p x JOIN p y ON y.pattern = split_part(x.pattern, ' & ', 1) WHERE x.size = 2 AND x.pattern LIKE '% & size=%' UNION ALL SELECT split_part(x.pattern, ' & ', 2), split_part(x.pattern, ' & ', 1), x.n, x.impact, round(x.n / y.n::DOUBLE, 6) FROM p x JOIN p y ON y.pattern = split_part(x.pattern, ' & ', 2) WHERE x.size = 2 AND x.pattern LIKE 'size=%'")(v(lambda x: patterns.proposed(_patterns(x), "size")))

# solver

_POOL = """pool AS (SELECT DISTINCT c.record_id, c.key, l.amount_minor AS amount FROM cand c JOIN ledger l USING (key) WHERE c.record_id IN (SELECT record_id FROM bank WHERE is_mult)),
t AS (SELECT b.record_id, b.amount_minor AS target, coalesce(p.n, 0) AS n_pool FROM bank b LEFT JOIN (SELECT record_id, count(*) AS n FROM pool GROUP BY 1) p USING (record_id) WHERE is_mult),
it AS (SELECT p.*, t.target, row_number() OVER (PARTITION BY p.record_id ORDER BY p.key, p.amount) AS i FROM pool p JOIN t USING (record_id) WHERE n_pool <= 64 AND target > 0 AND amount > 0 AND amount <= target),
f AS (SELECT record_id, 1 AS k, key AS m FROM it WHERE amount = target
  UNION ALL SELECT a.record_id, 2, array_to_string(list_sort([a.key, b.key]), ',') FROM it a JOIN it b ON a.record_id = b.record_id AND a.i < b.i AND a.amount + b.amount = a.target
  UNION ALL SELECT a.record_id, 3, array_to_string(list_sort([a.key, b.key, c.key]), ',') FROM it a JOIN it b ON a.record_id = b.record_id AND a.i < b.i JOIN it c ON c.record_id = b.record_id AND b.i < c.i AND c.amount = a.target - a.amount - b.amount),
g AS (SELECT record_id, k, count(*) AS ways, min(m) AS m FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY k) = 1),
solved AS (SELECT t.record_id, target, n_pool, CASE WHEN target < 0 THEN 'invalid' WHEN target = 0 THEN 'solved' WHEN n_pool > 64 THEN 'too_large' WHEN g.k IS NULL THEN 'infeasible' WHEN ways = 1 THEN 'solved' ELSE 'ambiguous' END AS status, g.k, g.m FROM t LEFT JOIN g USING (record_id))"""
SOLVED = CAND.rstrip() + ", " + _POOL


def _solved(x: View) -> DataFrame:
    """Answers for grouped credits, which travel as numbers."""
    targets = x.groups().select(F.col("number").alias("record_id"), F.col("amount_minor").alias("target"))
    got = solver.solve(targets, solver.pools_by_key(x.group_cand(), x.ledger)).withColumnRenamed("record_id", "number")
    return got.join(x.groups().select("number", "record_id"), "number").select("record_id", "target", "n_pool", "status", "k", "members")


def _group_cand(x: View) -> DataFrame:
    """Candidates of grouped credits by name."""
    return x.group_cand().withColumnRenamed("record_id", "number").join(x.groups().select("number", "record_id"), "number").select("record_id", "key")


query("solve_status", SOLVED + "SELECT status, k, count(*) AS n FROM (SELECT status, CASE WHEN status = 'solved' THEN k ELSE 0 END AS k FROM solved) GROUP BY ALL")(v(lambda x: _solved(x).groupBy("status", F.coalesce("k", F.lit(0)).alias("k")).agg(F.count("*").alias("n"))))
query("solve_members", SOLVED + "SELECT record_id, target, n_pool, status, CASE WHEN status = 'solved' THEN k ELSE 0 END AS k, CASE WHEN status = 'solved' THEN m END AS members FROM solved")(v(lambda x: _solved(x).withColumn("k", F.coalesce("k", F.lit(0)))))
_TRUE = "truth AS (SELECT 'g' || account || '_' || day AS record_id, count(*) AS true_size, string_agg(key, ',' ORDER BY key) AS members FROM ledger GROUP BY account, day)"
query(
    "solver_by_size",
    SOLVED + f", {_TRUE} SELECT true_size, count(*) AS n, count(*) FILTER (status = 'solved' AND m = members) AS recovered, count(*) FILTER (status = 'solved' AND m <> members) AS wrong, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status IN ('infeasible', 'too_large')) AS unresolved, count(*) >= 20 AS meaningful FROM solved JOIN truth USING (record_id) GROUP BY 1",
)(v(lambda x: settle.by_size(_solved(x), _truth(x))))

# residuals

_R0 = """, near AS (SELECT d.record_id, d.amount_minor, s.n_rows, (SELECT a FROM (SELECT unnest(s.amounts) AS a) ORDER BY abs(d.amount_minor - a), a LIMIT 1) AS nearest FROM decided d JOIN ranked b ON d.record_id = b.record_id JOIN stats s ON b.key = s.key WHERE d.outcome <> 'posted'),
r AS (SELECT record_id, amount_minor AS amount, n_rows, amount_minor - nearest AS residual FROM near WHERE amount_minor <> nearest),
g AS (SELECT *, unnest([{'p': 0, 'c': 'BANK_CHARGE', 'g': abs(amount) * 25 // 10000}, {'p': 1, 'c': 'ROUNDING', 'g': greatest(n_rows, 1)}, {'p': 2, 'c': 'FX_DIFFERENCE', 'g': abs(amount) // 100}, {'p': 3, 'c': 'PARTIAL_PAYMENT', 'g': abs(amount)}, {'p': 4, 'c': 'UNEXPLAINED', 'g': NULL}]) AS u FROM r),
fits AS (SELECT record_id, amount, residual, n_rows, u.p AS place, u.c AS cause, CASE WHEN u.p = 4 THEN 0.05::DOUBLE ELSE 1.0 / (1.0 + abs(abs(residual) - u.g) / greatest(least(abs(residual), u.g), 1)::DOUBLE) END AS fit FROM g),
best AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY fit DESC, place) AS rank FROM fits) """


def _residuals(x: View, fee_bps: int = 25) -> DataFrame:
    d = decide.decided(x.features(), keep=("best_amount", "best_rows")).where("outcome <> 'posted' and best_rows is not null")
    r = d.select("record_id", F.col("amount_minor").alias("amount"), F.col("best_rows").alias("n_rows"), (F.col("amount_minor") - F.col("best_amount")).alias("residual")).where("residual <> 0")
    return r.withColumn("causes", residual.causes(F.col("residual"), F.col("amount"), F.col("n_rows"), fee_bps))


query("residual_causes", DECISIONS.rstrip() + _R0 + "SELECT record_id, residual, cause, round(fit, 6) AS fit, CAST(rank AS INTEGER) AS rank FROM best")(
    v(lambda x: _residuals(x).select("record_id", "residual", F.posexplode("causes").alias("pos", "c")).select("record_id", "residual", "c.cause", F.round("c.fit", 6).alias("fit"), (F.col("pos") + 1).alias("rank")))
)
_MAJOR = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || format('{{:,d}}', abs({0}) // 100) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0')"
query(
    "residual_template",
    DECISIONS.rstrip() + _R0 + "SELECT record_id, cause, CASE cause " + " ".join(f"WHEN '{c}' THEN replace(replace(replace('{t.replace(chr(39), chr(39) * 2)}', '{{gap}}', {_MAJOR.format('residual')}), '{{amount}}', {_MAJOR.format('amount')}), '{{lines}}', CAST(n_rows AS VARCHAR))" for c, t in residual.TEMPLATES.items())
    + " END AS sentence, substr(sha1(cause || '|' || residual || '|' || n_rows), 1, 12) AS situation FROM best WHERE rank = 1",
)(v(lambda x: _residuals(x).withColumn("cause", F.col("causes")[0]["cause"]).select("record_id", "cause", residual.sentence(F.col("cause"), F.col("residual"), F.col("amount"), F.col("n_rows")).alias("sentence"), residual.situation(F.col("cause"), F.col("residual"), F.col("n_rows")).alias("situation"))))
query("situations", DECISIONS.rstrip() + _R0 + "SELECT cause, residual, n_rows, count(*) AS n FROM best WHERE rank = 1 GROUP BY ALL")(v(lambda x: _residuals(x).groupBy(F.col("causes")[0]["cause"].alias("cause"), "residual", "n_rows").agg(F.count("*").alias("n"))))

# queue and aging

_QUEUE = DECISIONS.rstrip() + ", q AS (SELECT *, abs(amount_minor) AS value FROM decided WHERE outcome <> 'posted') "
query("queue_cumshare", _QUEUE + "SELECT record_id, CAST(value AS BIGINT) AS value, round(value / sum(value) OVER ()::DOUBLE, 9) AS share, round(sum(value) OVER (ORDER BY value DESC, record_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER ()::DOUBLE, 6) AS cum_share FROM q")(v(lambda x: settle.queue(x.decisions())))
query("queue_top100", _QUEUE + "SELECT record_id, outcome, CAST(value AS BIGINT) AS value, CAST((SELECT count(*) FROM q) AS BIGINT) AS n_total FROM q ORDER BY value DESC, record_id LIMIT 100")(
    v(lambda x: (lambda q: q.orderBy(F.desc("value"), "record_id").limit(100).join(F.broadcast(q.agg(F.count("*").alias("n_total")))))(x.decisions().where("outcome <> 'posted'").select("record_id", "outcome", F.abs("amount_minor").alias("value"))))
)
query(
    "aging_buckets",
    _QUEUE + """, s AS (SELECT max(day) - min(day) AS span FROM decided), a AS (SELECT value, max(day) OVER () - day AS age FROM q WHERE day IS NOT NULL)
      SELECT CASE WHEN age < 30 THEN '0-30 days' WHEN age < 60 THEN '30-60 days' WHEN age < 90 THEN '60-90 days' ELSE '90+ days' END AS bucket, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM a, s WHERE span >= 60 GROUP BY 1""",
)(v(lambda x: settle.aging(x.decisions())))

# splits and measures

query(
    "temporal_split",
    BASE.rstrip() + """, g AS (SELECT match_id AS grp, min(day) AS first_day FROM bank GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first_day, grp) AS p, count(*) OVER () AS n FROM g WHERE first_day IS NOT NULL)
      SELECT grp, CAST(first_day AS VARCHAR) AS first_day, CASE WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN p <= floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r UNION ALL SELECT grp, NULL, 'train' FROM g WHERE first_day IS NULL""",
)(v(lambda x: evaluate.temporal_split(x.bank).withColumn("first_day", F.col("first_day").cast("string"))))
query("split_overlap", BASE + f"SELECT account AS grp, count(DISTINCT split) AS n_splits FROM bank JOIN ({SQL['temporal_split']}) s ON s.grp = bank.match_id GROUP BY 1 HAVING count(DISTINCT split) > 1")(
    v(lambda x: evaluate.split_overlap(x.bank.join(_split(x), "match_id"), "account"))
)


def _methods(x: View) -> DataFrame:
    """How lines were matched before: by hand at the two highest discounts, else by the line's place."""
    at = table(x.spark, x.sf_dir, "lineitem")
    return at.select(F.concat(F.lit("m"), "l_orderkey").alias("match_id"), F.col("l_linenumber").alias("place"), F.when(F.col("l_discount") >= 0.09, "MANUAL").otherwise(F.concat(F.lit("RULE-"), F.col("l_linenumber").cast("string"))).alias("method"))


query(
    "incumbent_compare",
    DECISIONS.rstrip() + """, m AS (SELECT 'm' || l_orderkey AS match_id, CASE WHEN bool_or(l_discount >= 0.09) THEN 'MANUAL' ELSE 'RULE-' || min(l_linenumber) END AS rule FROM lineitem GROUP BY 1)
      SELECT coalesce(rule, 'MANUAL') AS rule, count(*) AS n, count(*) FILTER (outcome = 'posted') AS posted, count(*) FILTER (outcome = 'posted' AND key = label) AS posted_right FROM decided LEFT JOIN m USING (match_id) GROUP BY 1""",
)(v(lambda x: x.judged().join(evaluate.incumbent(_methods(x)), "match_id", "left").groupBy(F.coalesce("rule", F.lit("MANUAL")).alias("rule")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "posted").alias("posted"), F.count_if((F.col("outcome") == "posted") & (F.col("key") == F.col("label"))).alias("posted_right"))))
query(
    "blocking_report",
    CAND.rstrip() + """, n AS (SELECT b.record_id, b.is_mult, count(c.key) AS n, max((c.key = b.label)::INT) AS hit FROM bank b LEFT JOIN cand c USING (record_id) GROUP BY 1, 2)
      SELECT count(*) AS n_records, round(avg(CASE WHEN NOT is_mult THEN coalesce(hit, 0) END), 6) AS recall, count(*) FILTER (n = 0) AS n_without, round(avg(n), 6) AS mean_all, quantile_cont(n, 0.5)::DOUBLE AS median_all, quantile_cont(n, 0.95)::DOUBLE AS p95_all, max(n) AS max_all,
        round(avg(n) FILTER (n > 0), 6) AS mean_some, (quantile_cont(n, 0.5) FILTER (n > 0))::DOUBLE AS median_some, (quantile_cont(n, 0.95) FILTER (n > 0))::DOUBLE AS p95_some FROM n""",
)(v(lambda x: evaluate.blocking_report(x.bank, x.cand())))
query("top1_mrr", RANKED + "SELECT count(*) AS n, round(avg((rank = 1)::INT), 6) AS top1, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM ranks WHERE key = label")(v(lambda x: evaluate.top1_mrr(rank.with_ranks(x.scored()).join(x.bank.select("record_id", "label"), "record_id"))))
_MULT = PAIRED.rstrip() + ", a AS (SELECT record_id, max(amount_exact) AS ex, min(miss) AS miss FROM pairs GROUP BY 1), z AS (SELECT b.record_id AS id, round(coalesce(a.miss, 0) / (coalesce(a.miss, 0) + 100000.0::DOUBLE), 6) AS score, b.is_mult::INT AS truth FROM bank b LEFT JOIN a USING (record_id)) "


def _mult_scores(x: View) -> DataFrame:
    """How far the nearest candidate's amount is, as a score of being grouped."""
    near = x.pairs().groupBy("record_id").agg(F.min("miss").alias("miss"))
    miss = F.coalesce("miss", F.lit(0))
    return x.bank.join(near, "record_id", "left").select(F.col("record_id").alias("id"), F.round(miss / (miss + F.lit(100000.0)), 6).alias("score"), F.col("is_mult").cast("int").alias("truth"))


query("confusion", _MULT + ", c AS (SELECT count(*) FILTER (score >= 0.7 AND truth = 1) AS tp, count(*) FILTER (score >= 0.7 AND truth = 0) AS fp, count(*) FILTER (score < 0.7 AND truth = 1) AS fn, count(*) FILTER (score < 0.7 AND truth = 0) AS tn FROM z) SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")(v(lambda x: evaluate.confusion(_mult_scores(x), 0.7)))
_CUM = _MULT + ", s AS (SELECT score, count(*) AS n, sum(truth) AS pos FROM z GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM s) "
query("pr_auc", _CUM + "SELECT round(sum(pos * cp / cn::DOUBLE) / sum(pos)::DOUBLE, 6) AS pr_auc, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives FROM c")(v(lambda x: evaluate.pr_auc(_mult_scores(x))))
query("roc_auc", _CUM + "SELECT round(sum(pos * ((tn - tp) - (cn - cp) + 0.5::DOUBLE * (n - pos))) / (max(tp) * (max(tn) - max(tp)))::DOUBLE, 6) AS roc_auc FROM c")(v(lambda x: evaluate.roc_auc(_mult_scores(x))))
query("ece_table", _MULT + "SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(truth), 6) AS share_right, round(abs(avg(score) - avg(truth)) * count(*) / (SELECT count(*) FROM z), 6) AS ece_part, round(avg((score - truth) * (score - truth)) * count(*) / (SELECT count(*) FROM z), 6) AS brier_part FROM z GROUP BY 1")(v(lambda x: evaluate.reliability(_mult_scores(x))))
query(
    "alert_budget",
    _MULT + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS p, count(*) OVER () AS n FROM z) SELECT b.budget, CAST(floor(max(n) * b.budget) AS BIGINT) AS alerts, CAST(sum(truth) FILTER (p <= floor(n * b.budget)) AS BIGINT) AS hits, round(sum(truth) FILTER (p <= floor(n * b.budget)) / floor(max(n) * b.budget), 6) AS precision, round(sum(truth) FILTER (p <= floor(n * b.budget)) / (SELECT sum(truth) FROM z)::DOUBLE, 6) AS recall FROM r, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE)) b(budget) GROUP BY 1",
)(v(lambda x: evaluate.alert_budget(_mult_scores(x))))
query(
    "nmi_leakage",
    DECISIONS.rstrip() + """, j AS (SELECT path AS x, is_mult AS y, count(*) AS n FROM decided GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j)
      SELECT 'path' AS column_name, round(2.0::DOUBLE * sum(n / t::DOUBLE * ln(n * t / (nx * ny)::DOUBLE)) / (-sum(n / t::DOUBLE * ln(nx / t::DOUBLE)) - sum(n / t::DOUBLE * ln(ny / t::DOUBLE))), 6) AS nmi FROM w""",
)(v(lambda x: evaluate.nmi(x.judged(), "path", "is_mult")))
_LEAK = ("account", "n_candidates", "exact", "late", "path")
query(
    "leakage_columns",
    DECISIONS.rstrip() + ", f AS MATERIALIZED (SELECT account, n_blocked AS n_candidates, n_exact AS exact, day % 7 AS late, path, is_mult AS y FROM decided), "
    + ", ".join(f"j{i} AS (SELECT '{c}' AS c, {c} AS x, y, count(*) AS n FROM f GROUP BY ALL), w{i} AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j{i})" for i, c in enumerate(_LEAK))
    + " SELECT c AS column_name, nmi, nmi >= 0.95 AS suspicious FROM (" + " UNION ALL ".join(f"SELECT c, round(coalesce(2.0::DOUBLE * sum(n / t::DOUBLE * ln(n * t / (nx * ny)::DOUBLE)) / nullif(-sum(n / t::DOUBLE * ln(nx / t::DOUBLE)) - sum(n / t::DOUBLE * ln(ny / t::DOUBLE)), 0), 0), 6) AS nmi FROM w{i} GROUP BY 1" for i in range(len(_LEAK))) + ")",
)(v(lambda x: evaluate.leakage(x.judged().select("account", F.col("n_blocked").cast("string").alias("n_candidates"), F.col("n_exact").cast("string").alias("exact"), (F.col("day") % 7).cast("string").alias("late"), "path", "is_mult"), list(_LEAK), "is_mult")))
query("column_population", BASE + "SELECT count(*) AS n, round(count(account) / count(*)::DOUBLE, 6) AS account, round(count(day) / count(*)::DOUBLE, 6) AS day, round(count(label) / count(*)::DOUBLE, 6) AS label FROM bank")(v(lambda x: x.bank.agg(F.count("*").alias("n"), *[F.round(F.count(c) / F.count("*"), 6).alias(c) for c in ("account", "day", "label")])))
query("loss_funnel", CAND + "SELECT count(*) FILTER (NOT is_mult) AS single_key, count(*) FILTER (NOT is_mult AND n = 0) AS no_candidate, count(*) FILTER (NOT is_mult AND n > 0 AND hit = 0) AS key_missed, count(*) FILTER (NOT is_mult AND hit = 1) AS ceiling FROM (SELECT b.record_id, b.is_mult, count(c.key) AS n, coalesce(max((c.key = b.label)::INT), 0) AS hit FROM bank b LEFT JOIN cand c USING (record_id) GROUP BY 1, 2)")(
    v(lambda x: x.bank.join(x.cand().groupBy("record_id").agg(F.count("*").alias("n")), "record_id", "left").join(x.cand().withColumnRenamed("key", "label").withColumn("hit", F.lit(1)), ["record_id", "label"], "left").where("not is_mult").agg(F.count("*").alias("single_key"), F.count_if(F.col("n").isNull()).alias("no_candidate"), F.count_if(F.col("n").isNotNull() & F.col("hit").isNull()).alias("key_missed"), F.count_if(F.col("hit") == 1).alias("ceiling")))
)
query("direct_rule", DECISIONS + "SELECT CASE WHEN abs(amount_minor) < 1000000 THEN 'small' WHEN abs(amount_minor) < 5000000 THEN 'medium' ELSE 'large' END AS size, CASE WHEN n_scored = 1 THEN '1' WHEN n_scored <= 4 THEN '2-4' ELSE '5+' END AS candidates, count(*) AS n, count(*) FILTER (key = label) AS n_right FROM decided WHERE n_exact = 1 AND key IS NOT NULL GROUP BY ALL")(
    v(lambda x: x.judged().where("n_exact = 1 and key is not null").groupBy(F.when(F.abs("amount_minor") < 1000000, "small").when(F.abs("amount_minor") < 5000000, "medium").otherwise("large").alias("size"), F.when(F.col("n_scored") == 1, "1").when(F.col("n_scored") <= 4, "2-4").otherwise("5+").alias("candidates")).agg(F.count("*").alias("n"), F.count_if(F.col("key") == F.col("label")).alias("n_right")))
)
query(
    "overview",
    DECISIONS + """, q AS (SELECT record_id, abs(amount_minor) AS a, row_number() OVER (ORDER BY abs(amount_minor) DESC, record_id) AS p, row_number() OVER (ORDER BY abs(amount_minor), record_id) AS up, count(*) OVER () AS n FROM decided WHERE outcome <> 'posted')
      SELECT CAST(count(*) AS BIGINT) AS n_queue, CAST(sum(a) AS BIGINT) AS value, CAST(max(a) AS BIGINT) AS largest, round(sum(a) FILTER (p <= 10) / sum(a)::DOUBLE, 6) AS top10_share, CAST(max(CASE WHEN up = n // 2 + 1 THEN a END) AS BIGINT) AS middle FROM q""",
)(v(lambda x: settle.overview(x.decisions())))
query("full_report", DECISIONS.rstrip() + ", m AS (SELECT DISTINCT key FROM decided WHERE outcome = 'posted'), k AS (SELECT DISTINCT key FROM ledger) SELECT CASE WHEN d.record_id IS NULL THEN 'ledger_only' WHEN d.key IS NULL THEN 'bank_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT record_id, CASE WHEN outcome = 'posted' THEN key END AS key FROM decided) d FULL JOIN k ON d.key = k.key GROUP BY 1")(
    v(lambda x: x.decisions().select("record_id", F.when(F.col("outcome") == "posted", F.col("key")).alias("k")).join(x.ledger.select("key").distinct(), F.col("k") == F.col("key"), "full").groupBy(F.when(F.col("record_id").isNull(), "ledger_only").when(F.col("k").isNull(), "bank_only").otherwise("both").alias("side")).agg(F.count("*").alias("n")))
)

query("split_table", BASE.rstrip() + """, g AS (SELECT match_id AS grp, min(day) AS first_day FROM bank GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first_day, grp) AS p, count(*) OVER () AS n FROM g WHERE first_day IS NOT NULL),
  s AS (SELECT grp, CASE WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN p <= floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r UNION ALL SELECT grp, 'train' FROM g WHERE first_day IS NULL)
  SELECT split, count(*) AS n_records, count(*) FILTER (is_mult) AS n_grouped, CAST(sum(abs(amount_minor)) AS BIGINT) AS value FROM bank JOIN s ON bank.match_id = s.grp GROUP BY 1""")(
    v(lambda x: x.bank.join(_split(x), "match_id").groupBy("split").agg(F.count("*").alias("n_records"), F.count_if(F.col("is_mult")).alias("n_grouped"), F.sum(F.abs("amount_minor")).alias("value")))
)
query("recall_by_account", CAND.rstrip() + ", h AS (SELECT b.account, b.record_id, bool_or(c.key = b.label) AS hit FROM bank b LEFT JOIN cand c USING (record_id) WHERE NOT is_mult AND account IS NOT NULL GROUP BY 1, 2) SELECT account, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) >= 20 AS meaningful FROM h GROUP BY 1")(
    v(lambda x: x.bank.where("not is_mult and account is not null").join(x.cand().withColumnRenamed("key", "label").withColumn("hit", F.lit(True)), ["record_id", "label"], "left").groupBy("account").agg(F.count("*").alias("n"), F.count_if(F.col("hit")).alias("hits")).withColumn("meaningful", F.col("n") >= 20))
)
query("situation_vectors", DECISIONS + "SELECT record_id, round(log10(greatest(abs(amount_minor), 1)) + n_scored + coalesce(CASE WHEN path = 'ranked' THEN margin END, 0.0) + coalesce(confidence, 0.0) + (n_exact = 1)::INT, 5) AS total FROM decided")(
    v(lambda x: x.decisions().select("record_id", F.round(F.aggregate(situation_vector(F.col("amount_minor"), F.col("n_scored"), F.col("margin"), F.col("confidence"), F.col("lone_exact")), F.lit(0.0), lambda s, y: s + y), 5).alias("total")))
)

# settlements, corrections, cases

_ITEMS = "items AS (SELECT 'p' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS entity_id, CASE WHEN l_orderkey % 11 <> 0 THEN 'st' || l_suppkey || '_' || strftime(l_shipdate, '%Y%m') END AS settlement_id, CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS credit, CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END AS debit, CASE WHEN l_suppkey % 2 = 0 THEN 'INR' ELSE 'USD' END AS currency, CAST(l_shipdate AS DATE) AS settled_at FROM lineitem) "


def _items(x: View) -> DataFrame:
    t = table(x.spark, x.sf_dir, "lineitem")
    minor = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    back = F.col("l_returnflag") == "R"
    return t.select(
        F.concat(F.lit("p"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey")).alias("entity_id"), F.when(F.col("l_orderkey") % 11 != 0, F.concat(F.lit("st"), "l_suppkey", F.lit("_"), F.date_format("l_shipdate", "yyyyMM"))).alias("settlement_id"),
        F.when(back, 0).otherwise(minor).alias("credit"), F.when(back, minor).otherwise(0).alias("debit"), F.when(F.col("l_suppkey") % 2 == 0, "INR").otherwise("USD").alias("currency"), F.col("l_shipdate").cast("date").alias("settled_at"),
    )


query("settlements_grouped", "WITH " + _ITEMS + "SELECT settlement_id, CAST(sum(credit - debit) AS BIGINT) AS net_minor, count(*) AS n_lines, min(currency) AS currency, CAST(min(settled_at) AS VARCHAR) AS settled_at, string_agg(entity_id, ',' ORDER BY entity_id) AS entity_ids FROM items WHERE settlement_id IS NOT NULL GROUP BY 1 HAVING sum(credit - debit) > 0")(v(lambda x: settle.settlements(_items(x)).select("settlement_id", "net_minor", "n_lines", "currency", F.col("settled_at").cast("string").alias("settled_at"), F.array_join("entity_ids", ",").alias("entity_ids"))))
query(
    "settlement_pool",
    BASE.rstrip() + ", c AS (SELECT record_id, account, amount_minor, day FROM bank WHERE is_mult AND amount_minor > 0) SELECT c.record_id, count(*) AS n_pool, CAST(sum(l.amount_minor) AS BIGINT) AS pool_minor FROM c JOIN ledger l ON c.account = l.account AND l.amount_minor > 0 AND l.day BETWEEN c.day - 2 AND c.day GROUP BY 1",
)(v(lambda x: settle.pools(x.bank.where("is_mult").withColumnRenamed("account", "currency"), x.ledger.withColumnRenamed("account", "currency"), 2).select("record_id", "n_pool", "pool_minor")))
query("even_sample", BASE + ", r AS (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS p, count(*) OVER () AS n FROM bank), s AS (SELECT floor(i * n / 50.0::DOUBLE) AS want FROM range(50) t(i), (SELECT max(n) AS n FROM r)) SELECT record_id, CAST(p AS BIGINT) AS position FROM r WHERE p IN (SELECT want FROM s)")(v(lambda x: settle.even_sample(x.bank.select("record_id"), "record_id", 50)))
_LOCUS = """CASE WHEN routed AND is_mult THEN 'none' WHEN routed <> is_mult THEN 'multiplicity' WHEN NOT hit THEN 'blocking' WHEN ranked_keys IS NOT NULL AND key <> label THEN 'ranking' WHEN ranked_keys IS NOT NULL AND outcome <> 'posted' THEN 'threshold' ELSE 'none' END"""
query(
    "corrections_locus",
    DECISIONS.rstrip() + f", h AS (SELECT d.*, d.path = 'multiplicity' AS routed, EXISTS (SELECT 1 FROM cand c WHERE c.record_id = d.record_id AND c.key = d.label) AS hit FROM decided d) SELECT {_LOCUS} AS locus, count(*) AS n FROM h GROUP BY 1",
)(v(lambda x: settle.loci(x.judged()).groupBy("locus").agg(F.count("*").alias("n"))))
query(
    "loci_by_batch",
    DECISIONS.rstrip() + f", h AS (SELECT d.*, d.path = 'multiplicity' AS routed, EXISTS (SELECT 1 FROM cand c WHERE c.record_id = d.record_id AND c.key = d.label) AS hit, (row_number() OVER (ORDER BY day NULLS FIRST, record_id) - 1) * 5 // count(*) OVER () AS batch FROM decided d) SELECT CAST(batch AS INTEGER) AS batch, {_LOCUS} AS locus, count(*) AS n FROM h GROUP BY 1, 2",
)(v(lambda x: _batched_loci(x).groupBy("batch", "locus").agg(F.count("*").alias("n"))))


def _batched_loci(x: View) -> DataFrame:
    """Records know their batch before they meet pairs, so nothing is joined by name after."""
    records = relearn.in_batches(x.records(), 5, ("day", "name"))
    judged = decide.decided(decide.looked_up(records, x.ledger, x.stats()), keep=("label", "is_mult", "batch", "hit"))
    return settle.loci(judged, more=("batch",))


_EVENTS = "SELECT CAST(user_id AS VARCHAR) AS record_id, CAST(event_id % 3 AS VARCHAR) AS run_id, event_id AS seq, event_type AS outcome FROM events"


def _trail(x: View) -> DataFrame:
    return table(x.spark, x.sf_dir, "events").select(F.col("user_id").cast("string").alias("record_id"), (F.col("event_id") % 3).cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("outcome"))


query("latest_decision", f"SELECT * FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY run_id, record_id ORDER BY seq DESC) = 1")(v(lambda x: audit.latest(_trail(x))))
query("audit_summary", f"SELECT run_id, outcome, count(*) AS n FROM ({_EVENTS}) GROUP BY ALL")(v(lambda x: _trail(x).groupBy("run_id", "outcome").agg(F.count("*").alias("n"))))
query(
    "case_retrieve",
    """WITH c AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS case_id, list_cosine_similarity(a.e, b.e) AS sim FROM c a JOIN c b ON a.label = b.label WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, case_id) AS rank FROM s WHERE sim >= 0.1) SELECT query_id, case_id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)(v(lambda x: settle.retrieve_vectors(table(x.spark, x.sf_dir, "embeddings"))))
query("case_outcomes", "SELECT CAST(user_id AS VARCHAR) AS case_id, count(*) AS applications, round(count(*) FILTER (event_type <> 'purchase') / count(*)::DOUBLE, 6) AS accuracy, count(*) >= 3 AND count(*) FILTER (event_type <> 'purchase') / count(*)::DOUBLE < 0.9 AS retired FROM events GROUP BY 1")(v(lambda x: learn.outcomes(table(x.spark, x.sf_dir, "events").select(F.col("user_id").cast("string").alias("case_id"), (F.col("event_type") != "purchase").alias("correct")))))
query("negative_sample", PAIRED.rstrip() + """, s AS (SELECT record_id, key, (key = label)::INT AS is_label, max((key = label)::INT) OVER (PARTITION BY record_id) AS has FROM pairs WHERE NOT is_mult)
   SELECT record_id, key, is_label FROM s WHERE has = 1 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY is_label DESC, md5(concat_ws('|', record_id, key, '7')), key) <= 25""")(v(lambda x: rank.training_pairs(x.pairs()).select("record_id", "key", "is_label")))
query("placebo_keys", BASE.rstrip() + """, k AS (SELECT key, row_number() OVER (ORDER BY key) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT key FROM ledger)),
   d AS (SELECT record_id, label, (p - 1 + CAST('0x' || substr(md5(concat_ws('|', record_id, '7')), 1, 8) AS BIGINT) % greatest(n - 1, 1) + 1) % n + 1 AS q FROM bank JOIN k ON k.key = label WHERE NOT is_mult)
   SELECT record_id, label, k.key AS wrong_key FROM d JOIN k ON k.p = d.q""")(v(lambda x: learn.wrong_keys(x.bank.where("not is_mult").select("record_id", "label"), x.ledger.select("key"))))
_TURNS = """,
  a AS MATERIALIZED (SELECT locus, row_number() OVER (PARTITION BY locus ORDER BY seq, case_id) AS n, case_id, v FROM arrivals),
  r(locus, n, kept, hit) AS (
    SELECT locus, 0::BIGINT, []::STRUCT(id VARCHAR, v DOUBLE[])[], NULL::VARCHAR FROM a GROUP BY locus
    UNION ALL
    SELECT locus, n, CASE WHEN hit IS NULL THEN list_append(kept, {'id': case_id, 'v': v}) ELSE kept END, hit FROM (
      SELECT r.locus, a.n, r.kept, a.case_id, a.v, list_filter(r.kept, lambda k: list_cosine_similarity(k.v, a.v) >= 0.95 - 1e-12)[1].id AS hit FROM r JOIN a ON a.locus = r.locus AND a.n = r.n + 1)),
  e AS (SELECT r.locus, coalesce(hit, case_id) AS case_id FROM r JOIN a ON a.locus = r.locus AND a.n = r.n)
  SELECT locus, case_id, count(*) - 1 AS confirmations FROM e GROUP BY ALL"""
_DISPUTE_TURNS = "WITH RECURSIVE " + fx.DISPUTES + ", arrivals AS (SELECT * FROM disputes)" + _TURNS
query("case_retain", "WITH RECURSIVE arrivals AS (SELECT vec_id AS seq, 'c' || vec_id AS case_id, CAST(label AS VARCHAR) AS locus, embedding::DOUBLE[] AS v FROM embeddings)" + _TURNS)(v(lambda x: learn.retain(table(x.spark, x.sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.concat(F.lit("c"), "vec_id").alias("case_id"), F.col("label").cast("string").alias("locus"), F.col("embedding").alias("situation")))))
query("dispute_cases", _DISPUTE_TURNS)(v(lambda x: cases.retain(fx.disputes(x.spark, x.sf_dir))))


@query("dispute_cases_streamed", _DISPUTE_TURNS)
def dispute_cases_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cases from a stream that gets arrivals in order, a part at a time; the state machine keeps them.

    A part is one micro-batch, as a run of the stream takes all that is there, so its files
    may be written by many tasks. It holds some :data:`ARRIVALS`, whatever the table's size,
    and rows of one seq are in one part.
    """
    root = scratch_path(spark)
    seqs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("seq"))
    n = max(3, -(-seqs.count() // ARRIVALS))
    cuts = sorted(set(seqs.select(F.percentile_approx("seq", [i / n for i in range(1, n)]).alias("p")).first().p or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: F.col("seq") > c))
    rows = fx.disputes(spark, sf_dir)
    parts = rows.withColumn("part", part)
    parts.write.partitionBy("part").parquet(f"{root}/parts")
    for i in range(len(cuts) + 1):
        at = spark.read.schema(parts.schema).parquet(f"{root}/parts").where(F.col("part") == i)
        at.select(*rows.columns).write.mode("append").parquet(f"{root}/arrivals")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/arrivals")
        feed.retain_feed(stream).writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return feed.kept_cases(spark.read.schema("locus string, seq long, case_id string, event string").parquet(f"{root}/events"))


query(
    "dispute_retrieve",
    with_(fx.DISPUTES) + """, s AS (SELECT a.case_id AS query_id, b.case_id, list_cosine_similarity(a.v, b.v) AS sim FROM disputes a JOIN disputes b ON a.locus = b.locus AND a.case_id <> b.case_id WHERE a.seq % 20 = 0)
       SELECT query_id, case_id, round(sim, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, case_id) AS INTEGER) AS rank FROM s WHERE sim >= 0.85 QUALIFY rank <= 5""",
)(v(lambda x: (lambda at: cases.retrieve(at.where("seq % 20 = 0").withColumnRenamed("case_id", "query_id"), at.withColumn("retired", F.lit(False)), own=False, digits=9).withColumn("similarity", F.round("similarity", 6)))(fx.disputes(x.spark, x.sf_dir))))
query("learning_arms")(v(lambda x: settle.arms(x.decisions(), x.bank.where("not is_mult").select("record_id", "label"))))
query("group_proposals", CAND.rstrip() + """, pool AS (SELECT DISTINCT c.record_id, c.key, l.amount_minor AS amount FROM cand c JOIN ledger l USING (key) WHERE c.record_id IN (SELECT record_id FROM bank WHERE is_mult)),
   t AS (SELECT b.record_id, b.amount_minor AS target, p.n FROM bank b JOIN (SELECT record_id, count(*) AS n FROM pool GROUP BY 1) p USING (record_id) WHERE is_mult),
   it AS (SELECT p.*, target, row_number() OVER (PARTITION BY p.record_id ORDER BY p.key, p.amount) AS i FROM pool p JOIN t USING (record_id) WHERE n <= 64 AND amount > 0 AND amount <= target + 100),
   w AS (SELECT record_id, target, 1 AS k, amount AS total, key AS m FROM it WHERE abs(target - amount) <= 100
     UNION ALL SELECT a.record_id, a.target, 2, a.amount + b.amount, array_to_string(list_sort([a.key, b.key]), ',') FROM it a JOIN it b ON a.record_id = b.record_id AND a.i < b.i WHERE abs(a.target - a.amount - b.amount) <= 100
     UNION ALL SELECT a.record_id, a.target, 3, a.amount + b.amount + c.amount, array_to_string(list_sort([a.key, b.key, c.key]), ',') FROM it a JOIN it b ON a.record_id = b.record_id AND a.i < b.i AND a.amount + b.amount < a.target + 100 JOIN it c ON c.record_id = b.record_id AND b.i < c.i WHERE abs(a.target - a.amount - b.amount - c.amount) <= 100),
   g AS (SELECT record_id, target, k, total, count(*) AS ways, min(m) AS m FROM w GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY abs(target - total), total > target, k, total) = 1)
   SELECT t.record_id, CASE WHEN n > 64 THEN 'too_large' WHEN ways IS NULL THEN 'infeasible' WHEN ways = 1 THEN 'solved' ELSE 'ambiguous' END AS status, CASE WHEN ways = 1 THEN m ELSE '' END AS members, CAST(CASE WHEN ways IS NULL THEN t.target ELSE t.target - total END AS BIGINT) AS residual
   FROM t LEFT JOIN g USING (record_id)""")(v(lambda x: _proposed(x)))

query(
    "settlement_verdicts",
    SOLVED + f""", {_TRUE}, x AS (SELECT s.*, members FROM solved s JOIN truth USING (record_id)), c AS (SELECT record_id, count(DISTINCT key) AS n FROM cand GROUP BY 1),
      h AS (SELECT t.record_id, count(*) FILTER (EXISTS (SELECT 1 FROM cand WHERE cand.record_id = t.record_id AND cand.key = k)) AS held, count(*) AS n FROM (SELECT record_id, unnest(string_split(members, ',')) AS k FROM truth) t GROUP BY 1)
      SELECT CASE WHEN status = 'solved' AND m = x.members THEN 'found' WHEN status = 'solved' THEN 'wrong' WHEN status = 'ambiguous' THEN 'two fit' ELSE 'unresolved' END AS verdict, held < h.n OR n_pool > 64 AS unreachable, count(*) AS n
      FROM x JOIN h USING (record_id) GROUP BY ALL""",
)(v(lambda x: settle.verdicts(_solved(x), _truth(x), _group_cand(x)).groupBy("verdict", "unreachable").agg(F.count("*").alias("n"))))


def _proposed(x: View) -> DataFrame:
    targets = x.groups().select(F.col("number").alias("record_id"), F.col("amount_minor").alias("target"))
    got = solver.solve_general(targets, solver.pools(x.group_cand(), x.ledger), tolerance=100, cap=solver.CAP).withColumnRenamed("record_id", "number")
    return got.join(x.groups().select("number", "record_id"), "number").select("record_id", "status", "members", "residual")


def _truth(x: View) -> DataFrame:
    """The lines of grouped credits, whose keys are two or three."""
    by = x.ledger.groupBy("account", "day").agg(F.sort_array(F.collect_list("key")).alias("truth")).where(F.size("truth").between(2, 3))
    return by.select(F.concat(F.lit("g"), F.concat_ws("_", "account", "day")).alias("record_id"), "truth").join(x.groups().select("record_id"), "record_id", "left_semi")


_VERDICTS = SOLVED + f""", {_TRUE}, c AS (SELECT record_id, key FROM cand GROUP BY 1, 2),
  h AS (SELECT p.record_id, count(*) FILTER (c.key IS NOT NULL) AS held, count(*) AS size FROM (SELECT record_id, unnest(string_split(members, ',')) AS k FROM truth) p LEFT JOIN c ON c.record_id = p.record_id AND c.key = p.k GROUP BY 1),
  verdicts AS (SELECT s.record_id, target, n_pool, status, CASE WHEN status = 'solved' THEN coalesce(m, '') ELSE '' END AS members, t.members AS truth, size AS true_size, held < size OR n_pool > 64 AS unreachable,
     CASE WHEN status = 'solved' AND m = t.members THEN 'found' WHEN status = 'solved' THEN 'wrong' WHEN status = 'ambiguous' THEN 'two fit' ELSE 'unresolved' END AS verdict
     FROM solved s JOIN truth t USING (record_id) JOIN h USING (record_id))"""
query("settlement_listing", _VERDICTS + "SELECT record_id, target, n_pool, status, members, truth, verdict, unreachable FROM verdicts WHERE record_id IN (SELECT record_id FROM solved ORDER BY abs(target) DESC, record_id LIMIT 50)")(v(lambda x: settle.listing(_solved(x), _truth(x), _group_cand(x))))
query(
    "solver_rates",
    _VERDICTS + """SELECT true_size, count(*) AS n, round(count(*) FILTER (verdict IN ('found', 'wrong')) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (verdict = 'found') / nullif(count(*) FILTER (verdict IN ('found', 'wrong')), 0)::DOUBLE, 6) AS precision,
      round(count(*) FILTER (verdict = 'wrong') / count(*)::DOUBLE, 6) AS wrong_rate, count(*) FILTER (unreachable) AS unreachable FROM verdicts GROUP BY 1""",
)(v(lambda x: settle.rates(_solved(x), _truth(x), _group_cand(x))))
query("case_totals", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT count(*) AS n_cases, CAST(sum(n) AS BIGINT) AS confirmations FROM c")(v(lambda x: table(x.spark, x.sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_cases"), F.sum("n").alias("confirmations"))))
query("latest_cases", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")(v(lambda x: table(x.spark, x.sf_dir, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(10)))
query("rank_of_label", RANKED + "SELECT record_id, CAST(rank AS BIGINT) AS position FROM ranks WHERE key = label")(v(lambda x: rank.ranked(x.scored()).join(x.bank.select("record_id", "label"), "record_id").select("record_id", learn.rank_of(F.array("label"), F.col("ranked_keys")).alias("position")).where("position is not null")))
query("train_test_keys", BASE + ", g AS (SELECT DISTINCT label FROM bank WHERE NOT is_mult AND day < 0), h AS (SELECT DISTINCT label FROM bank WHERE NOT is_mult AND day >= 0) SELECT label FROM g INTERSECT SELECT label FROM h")(
    v(lambda x: x.bank.where("not is_mult and day < 0").select("label").intersect(x.bank.where("not is_mult and day >= 0").select("label")))
)
query("near_events", "SELECT a.user_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 7 DAY AND a.ts + INTERVAL 7 DAY WHERE a.event_type = 'purchase' AND b.event_type = 'click' GROUP BY 1")(
    v(lambda x: settle.near_events(table(x.spark, x.sf_dir, "events"), "purchase", "click", 7))
)
query("narrated", f"SELECT record_id, cause, sentence, 'template' AS source FROM ({SQL['residual_template']})")(v(lambda x: narrate.narrated(_residuals(x).withColumn("cause", F.col("causes")[0]["cause"]))))

query(
    "audit_rows",
    DECISIONS + "SELECT record_id, path, outcome, key, CAST(n_blocked AS BIGINT) AS n_candidates, amount_minor, round(threshold, 9) AS threshold, '1' AS policy_version, 'decision' AS kind, row_number() OVER (ORDER BY record_id) AS seq FROM decided",
)(v(lambda x: audit.entries(x.decisions()).select("record_id", "path", "outcome", "key", "n_candidates", "amount_minor", F.round("threshold", 9).alias("threshold"), "policy_version", "kind", "seq")))


query("no_ranker", BASE + "SELECT 'queued' AS outcome, 'no_ranker' AS path, count(*) AS n, count(*) FILTER (amount_minor < 0) AS negative FROM bank")(
    v(lambda x: decide.without_ranker(x.bank).groupBy("outcome", "path").agg(F.count("*").alias("n"), F.count_if(F.col("amount_minor") < 0).alias("negative")))
)
# scores are made unusable for every third order: the batch goes on, and these records are queued
query("model_errors", DECISIONS + "SELECT CASE WHEN path = 'ranked' AND confidence IS NOT NULL AND amount_minor % 3 = 0 THEN 'model_error' ELSE path END AS path, CASE WHEN path = 'ranked' AND confidence IS NOT NULL AND amount_minor % 3 = 0 THEN 'queued' ELSE outcome END AS outcome, count(*) AS n FROM decided GROUP BY ALL")(
    v(lambda x: decide.decided(x.features().withColumn("margin", F.when(F.col("amount_minor") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("margin")))).groupBy("path", "outcome").agg(F.count("*").alias("n")))
)

# uploads: orders written as files with faults, and read again


def _upload(spark: SparkSession, sf_dir: str, header: list[str], key: bool) -> str:
    k = F.col("o_orderkey")
    at = table(spark, sf_dir, "orders").orderBy("o_orderkey")
    amount = F.when(k % 50 == 1, "abc").when(k % 50 == 2, "").otherwise(F.translate(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), ",.", ".,"))
    day = F.when(k % 50 == 3, "not a date").when(k % 50 == 4, "").otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    account = F.when(k % 50 == 5, "  ").otherwise(F.concat(F.lit('a "quoted"\n'), F.col("o_custkey").cast("string")))
    cols = [amount, day, account, *([F.concat(F.lit("B"), k)] if key else [])]
    path = scratch_path(spark)
    at.select(*[c.alias(h) for c, h in zip(cols, header, strict=True)]).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return path


_UPLOADED = """SELECT *, CASE WHEN k % 50 = 1 THEN 'unreadable amount' WHEN k % 50 = 2 THEN 'blank amount' WHEN k % 50 = 3 THEN 'unreadable date' WHEN k % 50 = 4 THEN 'blank date' END AS error FROM (
  SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * 100 AS BIGINT) AS m, CASE WHEN o_orderkey % 50 = 5 THEN NULL ELSE 'a "quoted"' || chr(10) || o_custkey END AS account,
         CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d, 1 + row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)"""


def _both(good: DataFrame, bad: DataFrame, name: str) -> DataFrame:
    none = F.lit(None)
    return good.select(name, "account", "amount_minor", "day", none.cast("string").alias("error")).union(bad.select(name, none.cast("string"), none.cast("long"), none.cast("int"), "error"))


query("upload_bank", f"SELECT 'B' || k AS record_id, CASE WHEN error IS NULL THEN account END AS account, CASE WHEN error IS NULL THEN m END AS amount_minor, CASE WHEN error IS NULL THEN d END AS day, error FROM ({_UPLOADED})")(
    lambda spark, sf_dir: _both(*csv_files.read_bank(spark, _upload(spark, sf_dir, ["Txn Amt (EUR)", "Booked", "IBAN", "Ref"], True))[:2], "record_id")
)
query("upload_ledger", f"SELECT 'row-' || n AS key, CASE WHEN error IS NULL THEN account END AS account, CASE WHEN error IS NULL THEN m END AS amount_minor, CASE WHEN error IS NULL THEN d END AS day, error FROM ({_UPLOADED})")(
    lambda spark, sf_dir: _both(*csv_files.read_ledger(spark, _upload(spark, sf_dir, ["amount", "Val Dt", "A/c No"], False))[:2], "key")
)

# text of money and dates

_MONEY = """SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' -' || p WHEN 3 THEN left(p, length(p) - 3) WHEN 4 THEN left(p, length(p) - 2) WHEN 5 THEN left(p, length(p) - 1) WHEN 6 THEN p || '5'
    WHEN 7 THEN left(p, 1) || ',' || substr(p, 2) || ' ' WHEN 8 THEN right(p, 3) WHEN 9 THEN 'EUR ' || p WHEN 10 THEN '--' || p ELSE p END AS raw FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS p FROM orders)"""


def _money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as text, of which eleven in twelve have a fault or a form of their own."""
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    n = F.length(p)
    forms = [F.lit(None).cast("string"), F.lit(""), F.concat(F.lit(" -"), p), F.left(p, n - 3), F.left(p, n - 2), F.left(p, n - 1), F.concat(p, F.lit("5")), F.concat(F.left(p, F.lit(1)), F.lit(","), F.substring(p, 2, 99), F.lit(" ")), F.right(p, F.lit(3)), F.concat(F.lit("EUR "), p), F.concat(F.lit("--"), p), p]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.get(F.array(*forms), (F.col("o_orderkey") % 12).cast("int")).alias("raw"))


query("money_parse", f"SELECT id, coalesce(CASE WHEN regexp_full_match(replace(trim(raw), ',', ''), '-?(\\d+(\\.\\d{{0,2}})?|\\.\\d{{1,2}})') THEN CAST(round(CAST(replace(trim(raw), ',', '') AS DECIMAL(18, 2)) * 100) AS BIGINT) END, -999999) AS minor, CASE WHEN trim(coalesce(raw, '')) = '' THEN 'blank' WHEN NOT regexp_full_match(replace(trim(raw), ',', ''), '-?(\\d+(\\.\\d{{0,2}})?|\\.\\d{{1,2}})') THEN 'unreadable' END AS error FROM ({_MONEY}) t(id, raw)")(
    lambda spark, sf_dir: _money_texts(spark, sf_dir).select("id", F.coalesce(money.strict_minor(F.col("raw")), F.lit(-999999).cast("long")).alias("minor"), money.money_error(F.col("raw"), money.strict_minor(F.col("raw"))).alias("error"))
)
query("date_parse", "SELECT o_orderkey, date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders")(
    lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_day(F.date_format("o_orderdate", "M/d/yyyy"), "M/d/yyyy").cast("long").alias("day"))
)


# trained models and streams: no SQL says these


def _split(x: View) -> DataFrame:
    return evaluate.temporal_split(x.bank).select(F.col("grp").alias("match_id"), "split")


def _split_records(x: View, *columns: str) -> DataFrame:
    """The view's records, with numbers for ids, and the split of each; ``columns``, by default all, are kept."""
    return evaluate.with_split(x.records().select(*columns, "match_id") if columns else x.records())


def _ranker_rows(rankers: dict, test: DataFrame) -> DataFrame:
    labels = checkpointed(test.select("record_id", "label").distinct())
    out = None
    for name, scored in rankers.items():
        row = evaluate.top1_mrr(rank.with_ranks(scored).join(labels, "record_id")).withColumn("ranker", F.lit(name))
        out = row if out is None else out.union(row)
    return out


def _ranker_pairs(x: View) -> tuple[DataFrame, DataFrame]:
    """Training and test pairs, each written once with the columns that rankers need."""
    at = _split_records(x)
    # of records dealt out by their numbers, where windows need no further shuffle
    train = rank.training_pairs(x.brief_pairs(at.where("split = 'train' and not is_mult")))
    test = x.brief_pairs(at.where("split = 'test'"))
    return checkpointed(train.select(F.col("name").alias("record_id"), "key", "is_label", *features.PAIR)), checkpointed(test.select(F.col("name").alias("record_id"), "key", "label", "is_mult", *features.PAIR))


@query("gbt_rank")
def gbt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 and MRR of a trained ranker on the test split, beside the rules."""
    train, test = _ranker_pairs(View(spark, sf_dir))
    return _ranker_rows({"gbt": models.rank_scores(models.fit_ranker(train), test), "rules": rank.rules_score(test)}, test)


@query("learning_refits")
def learning_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of the test split under every arm; a ranker of the training split is grown on between them."""
    x = View(spark, sf_dir)
    train, test = _ranker_pairs(x)
    first = boost.fit_ranker(train, trees=6, depth=3)
    records = x.bank.join(_split(x).where("split = 'test'"), "match_id").select(*x.bank.columns)
    return relearn.relearn(spark, relearn.in_batches(records, 3), test, first, scratch_path(spark))


@query("lambda_rank")
def lambda_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 and MRR on the test split of rankers that learn the order within a record, or pairs by themselves, beside the rules."""
    train, test = _ranker_pairs(View(spark, sf_dir))
    forest = boost.empty_forest(train)
    blocks = boost.packed(train, forest)
    with ThreadPoolExecutor(2) as pool:  # both wait for small jobs most of the time
        found = dict(zip(("lambda", "pointwise"), pool.map(lambda kind: boost.grow(forest, blocks, trees=8, objective=kind).scores(test), ("rank", "point")), strict=True))
    return _ranker_rows(found | {"rules": rank.rules_score(test)}, test)


@query("gbt_multiplicity")
def gbt_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of a trained detector at 0.7 on the test split."""
    x = View(spark, sf_dir)
    records = _split_records(x, "record_id", "account", "amount_minor", "day", "is_mult").where("split <> 'val'").withColumn("is_mult", F.col("is_mult").cast("int"))
    prior = features.account_prior(records.where("split = 'train'"))
    pairs = x.brief_pairs(records.select("record_id", "account", "amount_minor", "day"))
    rows = checkpointed(features.mult_features(records, pairs, prior, ("is_mult", "split")))
    model = models.fit_detector(rows.where("split = 'train'"))
    scores = models.multiple_scores(model, rows.where("split = 'test'"), "is_mult").withColumnRenamed("is_mult", "truth")
    return evaluate.confusion(scores.withColumnRenamed("p_multiple", "score"), 0.7)


@query("isotonic_gate")
def isotonic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error on the test split of the bare sigmoid, and of Platt's and isotonic confidence fitted on validation; which of the two is picked there."""
    x = View(spark, sf_dir)
    # a record's margin depends on no other record, and those that train are not asked for
    asked = _split_records(x).where("split in ('val', 'test')")
    at = decide.looked_up(asked, x.ledger, x.stats()).where("margin is not null")
    at = checkpointed(at.select("record_id", "split", "margin", (~F.col("is_mult") & (F.col("key") == F.col("label"))).cast("int").alias("right")))
    val, test = at.where("split = 'val'"), at.where("split = 'test'")
    picked, _ = models.pick_calibrator(val)
    sure = {"isotonic": models.calibrated(models.fit_isotonic(val), test), "platt": models.calibrated(models.fit_platt(val), test), "sigmoid": test.withColumn("confidence", 1 / (1 + F.exp(-F.col("margin"))))}
    out = None
    for name, rows in sure.items():
        parts = evaluate.reliability(rows.select(F.col("confidence").alias("score"), F.col("right").alias("truth")))
        row = parts.agg(F.round(F.sum("ece_part"), 6).alias("ece"), F.round(F.sum("brier_part"), 6).alias("brier")).withColumn("calibrator", F.lit(name)).withColumn("picked", F.lit(name == picked))
        out = row if out is None else out.union(row)
    return out


@query("stream_parity", DECISIONS + "SELECT outcome, outcome AS streamed, count(*) AS n, CAST(0 AS BIGINT) AS differ FROM decided GROUP BY 1")
def stream_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose streamed decision differs from the batch one, by outcome; equal plans give none."""
    x = View(spark, sf_dir)
    root = scratch_path(spark)
    cols = ["record_id", "account", "amount_minor", "day"]
    x.bank.select(*cols).repartition(4).write.parquet(f"{root}/bank")
    stream = spark.readStream.schema(x.bank.select(*cols).schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/bank")
    feed.decision_feed(stream, x.ledger, f"{root}/decisions", f"{root}/state").awaitTermination()
    got = spark.read.parquet(f"{root}/decisions").select("record_id", F.col("outcome").alias("streamed"), F.col("key").alias("streamed_key"))
    both = feed.decide_batch(spark.read.parquet(f"{root}/bank"), x.ledger).join(got, "record_id", "full")
    return both.groupBy("outcome", "streamed").agg(F.count("*").alias("n"), F.count_if(~F.col("key").eqNullSafe(F.col("streamed_key"))).alias("differ"))


@query(
    "lonely_events",
    "SELECT user_id, count(*) AS n_pairs, count(*) FILTER (r IS NULL) AS lonely FROM (SELECT a.user_id, b.event_id AS r FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error' AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts + INTERVAL 1 DAY WHERE a.event_type = 'purchase') GROUP BY 1",
)
def lonely_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the errors of their user within a day, from two streams; those without any come once the watermark has passed them."""
    root = scratch_path(spark)
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    streams = []
    for kind, at, name in (("purchase", "lt", "l"), ("error", "rt", "r")):
        rows = e.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(at), F.col("event_id").alias(name))
        rows.coalesce(1).write.parquet(f"{root}/{kind}")
        # later rows of nobody move the watermark on, in batches of their own; without a key they would be dropped before it
        for years in (50, 51, 52):
            spark.range(1).select(F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"), F.make_timestamp(F.lit(2024 + years), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias(at), F.lit(-1).cast("long").alias(name)).write.mode("append").parquet(f"{root}/{kind}")
        streams.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{kind}"))
    # events of one file come in any order, so none is late within it
    joined = feed.near_in_time(*streams, "user_id", 1, "1 day", "left")
    joined.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(joined.schema).parquet(f"{root}/out").where("l <> -1")
    return got.groupBy("user_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("r").isNull()).alias("lonely"))
