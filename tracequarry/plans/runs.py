"""Evaluation and comparison queries. Orders stand for results, customers for tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import scalar
from tracequarry.operators import compare, evaluate
from tracequarry.plans.base import Plans, table

P = Plans()


def good() -> Column:
    return F.col("o_orderstatus") == "F"


def score() -> Column:
    return F.least(F.col("o_totalprice") / 500000, F.lit(1.0))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@P.query("""
SELECT o_orderpriority AS mode, count(*) AS tasks, round(avg(least(o_totalprice / 500000, 1.0)), 6) AS avg_score,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM orders GROUP BY 1""")
def eval_summary_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "mode")
    return rounded(evaluate.summarise(rows, good(), score(), ["mode"]), "avg_score", "success_rate")


@P.query("""
SELECT o_orderpriority AS mode, count(*) AS tasks, round(avg(least(o_totalprice / 500000, 1.0)), 6) AS score_avg,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS successes,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(o_orderkey % 50), 6) AS steps_avg
FROM orders GROUP BY 1""")
def rollout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "mode")
    return rounded(evaluate.rollout_summary(rows, good(), score(), F.col("o_orderkey") % 50, ["mode"]), "score_avg", "success_rate", "steps_avg")


@P.query("""
SELECT count(*) AS scenarios, round(100 * avg(CASE WHEN n = 3 AND good = 3 THEN 1.0 ELSE 0.0 END), 6) AS scenario_completion,
  round(100.0 * sum(good) / sum(n), 6) AS task_completion
FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS good FROM orders GROUP BY 1, 2)""")
def scenario_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("epoch", F.year("o_orderdate"))
    return rounded(evaluate.scenario_completion(rows, ["o_custkey", "epoch"], good()), "scenario_completion", "task_completion")


@P.query("SELECT CAST(o_orderkey AS VARCHAR) AS task_id FROM orders WHERE o_totalprice / 500000 < 0.2")
def low_reward_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 500000).alias("reward"))
    return evaluate.low_reward_ids(rows, "o_orderkey", "reward", 0.2)


@P.query("SELECT mode, count(*) AS tasks FROM (SELECT 'single' AS mode FROM orders UNION ALL SELECT 'evolved' FROM orders WHERE o_orderstatus <> 'P') GROUP BY mode")
def running_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    first = rows.select("o_orderkey", F.lit("single").alias("mode"))
    more = rows.where("o_orderstatus <> 'P'").select(F.lit("evolved").alias("mode"), "o_orderkey", F.lit(1).alias("bundle"))
    both = first.unionByName(more, allowMissingColumns=True)
    return both.groupBy("mode").agg(F.count(F.lit(1)).alias("tasks"))


def epoch(rows: DataFrame, year: int) -> DataFrame:
    fields = {"success": good(), "score": score(), "steps": (F.col("o_orderkey") % 50).cast("int")}
    within = (F.col("o_orderdate") >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp"))  # reaches the scan
    return compare.last_wins(rows.where(within), "o_custkey", ["o_orderdate", "o_orderkey"], fields)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("task_family"))
    return compare.longitudinal_pairs(items, epoch(rows, 1998), epoch(rows, 1999), "o_custkey")


PAIRS_SQL = """
WITH r AS (
  SELECT o_custkey, year(o_orderdate) AS y, o_orderstatus = 'F' AS success, least(o_totalprice / 500000, 1.0) AS score,
    CAST(o_orderkey % 50 AS INTEGER) AS steps, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders
), p AS (
  SELECT c.c_custkey AS o_custkey, c.c_mktsegment AS task_family, coalesce(a.success, false) AS prev_success, coalesce(a.score, 0) AS prev_score,
    coalesce(a.steps, 0) AS prev_steps, coalesce(b.success, false) AS curr_success, coalesce(b.score, 0) AS curr_score, coalesce(b.steps, 0) AS curr_steps
  FROM customer c LEFT JOIN r a ON a.o_custkey = c.c_custkey AND a.y = 1998 AND a.rn = 1 LEFT JOIN r b ON b.o_custkey = c.c_custkey AND b.y = 1999 AND b.rn = 1
  WHERE a.o_custkey IS NOT NULL OR b.o_custkey IS NOT NULL
), pairs AS (
  SELECT *, CASE WHEN NOT prev_success AND curr_success THEN 'improved' WHEN prev_success AND NOT curr_success THEN 'regressed'
    WHEN NOT prev_success THEN 'persistent_fail' ELSE 'stable_success' END AS category FROM p
)
"""


@P.query(PAIRS_SQL + "SELECT * FROM pairs")
def longitudinal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@P.query(PAIRS_SQL + """
SELECT d.category, count(p.category) AS n FROM (VALUES ('improved'), ('regressed'), ('persistent_fail'), ('stable_success')) d(category)
LEFT JOIN pairs p ON p.category = d.category GROUP BY 1""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.category_counts(pairs(spark, sf_dir))


@P.query(PAIRS_SQL + """, e AS (
  SELECT o_custkey // 1000 AS part, category, o_custkey, chr(10) || '#### Task ' || o_custkey || ': Customer' || chr(10) || 'Task family: ' || task_family || chr(10) || '- Previous epoch: '
    || CASE WHEN prev_success THEN 'PASS' ELSE 'FAIL' END || printf(' (score=%.2f, steps=%d)', prev_score, prev_steps) || chr(10) || '- Current epoch: '
    || CASE WHEN curr_success THEN 'PASS' ELSE 'FAIL' END || printf(' (score=%.2f, steps=%d)', curr_score, curr_steps) AS t FROM pairs
), s AS (
  SELECT g.part, o, title, string_agg(t, chr(10) ORDER BY o_custkey) AS body, count(t) AS n FROM (SELECT DISTINCT part FROM e) g
  CROSS JOIN (VALUES (1, 'regressed', 'Regressions (success -> fail) - HIGHEST PRIORITY'),
    (2, 'persistent_fail', 'Persistent Failures (fail -> fail)'), (3, 'improved', 'Improvements (fail -> success)'), (4, 'stable_success', 'Stable Successes (success -> success)')) d(o, c, title)
  LEFT JOIN e ON e.category = c AND e.part = g.part GROUP BY 1, 2, 3
)
SELECT part, '## Longitudinal Comparison Summary' || chr(10) || 'Total samples: ' || sum(n) || chr(10) || '- Improved (fail -> success): ' || max(n) FILTER (o = 3) || chr(10)
  || '- Regressed (success -> fail): ' || max(n) FILTER (o = 1) || chr(10) || '- Persistent failures (fail -> fail): ' || max(n) FILTER (o = 2) || chr(10)
  || '- Stable successes (success -> success): ' || max(n) FILTER (o = 4) || chr(10) || chr(10) || chr(10)
  || string_agg('### ' || title || chr(10) || coalesce(body, '(none)' || chr(10)), chr(10) || chr(10) ORDER BY o) AS report FROM s GROUP BY part""")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks, in one report for each thousand of customer numbers, so that no text grows with the table."""
    rows = pairs(spark, sf_dir).withColumns({"part": F.floor(F.col("o_custkey") / 1000), "id": F.col("o_custkey"), "task": F.lit("Customer")})
    return compare.comparison_text(rows, "o_custkey", ["part"])


@P.query("""
SELECT CASE WHEN a.o_orderstatus <> 'F' AND b.o_orderstatus = 'F' THEN 'improved' WHEN a.o_orderstatus = 'F' AND b.o_orderstatus <> 'F' THEN 'regressed'
  WHEN a.o_orderstatus <> 'F' THEN 'persistent_fail' ELSE 'stable_success' END AS category, count(*) AS n
FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 GROUP BY 1""")
def outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_orderkey", good().alias("before"))
    b = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("o_orderkey"), good().alias("after"))
    return a.join(b, "o_orderkey").groupBy(scalar.outcome(F.col("before"), F.col("after")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@P.query("""
SELECT o_orderkey, greatest(0, least(1, CASE WHEN o_totalprice / 1000 > 1 THEN o_totalprice / 1000 / 100 ELSE o_totalprice / 1000 END)) AS score FROM orders""")
def score_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.score_0_1(F.col("o_totalprice") / 1000).alias("score"))


@P.query("""
WITH t AS (SELECT o_orderkey, count(*) AS num, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS passed, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, bad = 0 AND passed = num AS success, num AS num_tests, passed, greatest(bad, num - passed) AS failed FROM t""")
def evaluation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    flag = F.col("l_returnflag")
    each = tests.groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("num"),
        F.collect_list(F.when(flag == "N", F.col("l_linenumber"))).alias("passes"),
        F.collect_list(F.when(flag == "R", F.col("l_linenumber"))).alias("failures"),
    )
    report = scalar.test_report(F.size("failures") == 0, F.col("num"), F.col("passes"), F.col("failures"))
    return each.select("o_orderkey", report.alias("r")).select("o_orderkey", "r.success", F.col("r.num_tests").cast("long").alias("num_tests"), F.col("r.passed").cast("long").alias("passed"), F.col("r.failed").cast("long").alias("failed"))
