"""Trajectory queries. Events of a user and turns of a conversation stand for steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions import scalar
from tracequarry.operators import scan, trajectory
from tracequarry.plans.base import Plans, table

P = Plans()
RANKED_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rev FROM events) """


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@P.query(RANKED_SQL + "SELECT event_id, user_id FROM r WHERE rn <= 24")
def traj_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.step_rows(events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "prefix").drop("ts")


@P.query(RANKED_SQL + "SELECT event_id, user_id FROM r WHERE rev <= 8")
def traj_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.step_rows(events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "tail", 8).drop("ts")


@P.query(RANKED_SQL + "SELECT event_id, user_id FROM r WHERE rn <= 1 OR rev <= 8")
def traj_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.step_rows(events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "head_tail").drop("ts")


@P.query("""
SELECT event_id, coalesce(string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '') AS history FROM events""")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return trajectory.history(rows, "user_id", "at", F.col("event_type")).select("event_id", F.array_join("history", ",").alias("history"))


@P.query("""
SELECT event_id, round(lag(value) OVER w, 6) AS score_before, round(value, 6) AS score_after, round(value - lag(value) OVER w, 6) AS score_delta
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def score_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    made = trajectory.transitions(rows, "user_id", "at", "value", 6)
    return made.select("event_id", F.round("score_before", 6).alias("score_before"), F.round("score_after", 6).alias("score_after"), "score_delta")


@P.query("""
WITH r AS (SELECT user_id, event_type, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY rn) = event_type THEN 0 ELSE 1 END AS new FROM r WHERE rn <= 12
), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM c
), k AS (SELECT user_id, run, min(event_type) AS a, count(*) AS n, max(total) AS total FROM g GROUP BY 1, 2)
SELECT user_id, string_agg(a || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ' -> ' ORDER BY run) || CASE WHEN max(total) > 12 THEN ' -> [truncated]' ELSE '' END AS sequence
FROM k GROUP BY 1""")
def action_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return trajectory.run_lengths(rows, "user_id", "at", "event_type")


@P.query("""
WITH r AS (SELECT user_id, event_type, row_number() OVER w AS rn, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), g AS (SELECT user_id, event_type, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY rn) AS BIGINT) AS run FROM r)
SELECT user_id, run, min(event_type) AS value, count(*) AS n FROM g GROUP BY 1, 2""")
def action_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of equal events of each user, by scans over ranges: no user's events in one task."""
    return scan.runs(events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type"), most=500)


@P.query("""
WITH s AS (SELECT conv_id, turn, role, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Nothing happens.' WHEN 1 THEN 'That is NOT POSSIBLE' WHEN 2 THEN 'same as ever ' WHEN 3 THEN 'same as ever' ELSE text END AS text FROM conversations),
c AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM s)
SELECT conv_id, turn FROM c WHERE lower(text) LIKE '%nothing happens%' OR lower(text) LIKE '%i don''t understand%' OR lower(text) LIKE '%you can''t%' OR lower(text) LIKE '%not possible%'
  OR lower(text) LIKE '%invalid%' OR (trim(before) = trim(text) AND role NOT IN ('look', 'inventory'))""")
def bad_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which two of six turns hold a phrase of failure and two more repeat each other."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    said = F.when(kind == 0, "Nothing happens.").when(kind == 1, "That is NOT POSSIBLE").when(kind == 2, "same as ever ").when(kind == 3, "same as ever").otherwise(F.col("text"))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("text", said).withColumn("before", before)
    return rows.where(scalar.bad_step("before", "text", "role")).select("conv_id", "turn")


def conversations_as_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.struct(
        F.col("turn").cast("int").alias("step"), F.lit("").alias("thought"), F.col("role").alias("action"),
        F.col("text").alias("observation"), F.lit("").alias("next_observation"), F.char_length("text").cast("double").alias("reward"),
    )
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", step.alias("s")))).alias("rows"))
    return rows.select("conv_id", F.transform("rows", lambda r: r["s"]).alias("trajectory"))


@P.query("""
WITH t AS (SELECT conv_id, string_agg('[step ' || turn || ' obs] ' || substring(text, 1, 700) || chr(10) || '[step ' || turn || ' action] ' || substring(role, 1, 200), chr(10) ORDER BY turn) AS t
  FROM conversations GROUP BY 1)
SELECT conv_id, sha256(CASE WHEN length(t) > 1000 THEN left(t, 500) || chr(10) || '...[truncated]...' || chr(10) || right(t, 500) ELSE t END) AS text_sha FROM t""")
def compact_trajectory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations_as_steps(spark, sf_dir)
    return rows.select("conv_id", F.sha2(trajectory.compact_text(F.col("trajectory"), 1000), 256).alias("text_sha"))


@P.query("""
SELECT conv_id AS task_id, count(*) FILTER (rn <= 3) AS n_steps, CAST(sum(least(length(text), 100)) FILTER (rn <= 3) AS BIGINT) AS seen, CAST(sum(length(text)) FILTER (rn <= 3) AS DOUBLE) AS reward
FROM (SELECT CAST(conv_id AS VARCHAR) AS conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1""")
def normal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations_as_steps(spark, sf_dir).withColumn("task_id", F.col("conv_id").cast("string"))
    made = trajectory.normal_record(rows, limit=3, chars=100)
    t = F.col("trajectory")
    return made.select(
        "task_id",
        F.size(t).cast("long").alias("n_steps"),
        F.aggregate(t, F.lit(0).cast("long"), lambda a, s: a + F.char_length(s["observation"])).alias("seen"),
        F.aggregate(t, F.lit(0.0), lambda a, s: a + s["reward"]).alias("reward"),
    )


@P.query("""
SELECT doc_id, CASE WHEN length(p) > 0 THEN 'pattern: ' || p || chr(10) ELSE '' END || 'edit_op: ' || lang || chr(10) || 'edit_target: ' || source AS text
FROM (SELECT doc_id, lang, source, CASE WHEN length(t) <= 300 THEN t ELSE rtrim(left(t, 285)) || ' ...[truncated]' END AS p
  FROM (SELECT doc_id, lang, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents))""".replace("\\\\", "\\"))
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = trajectory.embedding_text(F.col("text"), F.col("lang"), F.col("source"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))


@P.query(RANKED_SQL + """
, g AS (SELECT DISTINCT user_id, user_id % 5 + 1 AS s, user_id % 5 + 4 AS e FROM events)
SELECT g.user_id, g.s AS start, r.rn AS step, r.event_type FROM g JOIN r ON r.user_id = g.user_id AND r.rn BETWEEN g.s AND g.e""")
def trigger_range_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    steps = trajectory.ranked(rows, "user_id", ["ts", "event_id"]).select("user_id", F.col("rn").cast("long").alias("step"), "event_type")
    ranges = rows.select("user_id").distinct().select("user_id", (F.col("user_id") % 5 + 1).alias("start"), (F.col("user_id") % 5 + 4).alias("end"))
    return trajectory.range_segments(ranges, steps, key="user_id").drop("end")


@P.query("""SELECT conv_id, count(*) FILTER (turn < 3) AS n_prefix, string_agg(role, '>' ORDER BY turn) FILTER (turn < 3) AS roles FROM conversations GROUP BY 1""")
def replay_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = trajectory.replay_prefix(F.col("trajectory"), F.lit(3))
    return conversations_as_steps(spark, sf_dir).select(
        "conv_id", F.size(prefix).cast("long").alias("n_prefix"), F.array_join(F.transform(prefix, lambda s: s["action"]), ">").alias("roles")
    )
