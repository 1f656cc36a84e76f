"""Stream queries over the events table, which comes in weekly parts and is read in micro-batches.

The query is stopped and started again between the parts, from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.plans.base import Plans, table
from tracequarry.plans.scans import place
from tracequarry.streaming import ordered

P = Plans()
LATE = "6 hours"
DUE = "ts < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 6 HOUR FROM events)"


def in_parts(spark: SparkSession, rows: DataFrame, name: str, make, days: int = 8) -> DataFrame:
    """What a stream over the rows has put out after each part of so many days has come and the query was run again."""
    source, out, mark = (place(spark, f"{name}-{x}") for x in ("in", "out", "mark"))
    ordered.use_rocksdb(spark)
    part = F.floor(F.unix_timestamp("ts") / (86_400 * days))
    for r in rows.select(part.alias("p")).distinct().orderBy("p").collect():  # a row for each part of days
        rows.where(part == r.p).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ordered.to_folder(make(stream), out, mark).awaitTermination()
    return spark.read.parquet(out)


@P.query(f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS evidence_id, event_id AS ord, ts, CASE event_id % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'reactivate' WHEN 2 THEN 'reject' WHEN 3 THEN 'reject' ELSE 'attempt' END AS outcome FROM events WHERE {DUE}),
g AS (SELECT *, count(*) FILTER (outcome = 'reactivate') OVER w AS life, count(*) FILTER (outcome <> 'reactivate') OVER w AS attempts FROM e WINDOW w AS (PARTITION BY evidence_id ORDER BY ts, ord)),
r AS (SELECT *, count(*) FILTER (outcome = 'reject') OVER (PARTITION BY evidence_id, life ORDER BY ts, ord) AS rejects FROM g),
c AS (SELECT *, CASE WHEN outcome = 'accept' THEN 'archived' WHEN outcome = 'reactivate' THEN 'active' WHEN outcome = 'reject' AND rejects >= 2 THEN 'stale' END AS turn FROM r)
SELECT evidence_id, ord, CAST(attempts AS INTEGER) AS attempts, CAST(rejects AS INTEGER) AS rejects, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY evidence_id ORDER BY ts, ord), 'active') AS status FROM c""")
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the life of a card, of all events that the watermark has passed."""
    kind = F.pmod("event_id", F.lit(7))
    outcome = F.when(kind == 0, "accept").when(kind == 1, "reactivate").when(kind.isin(2, 3), "reject").otherwise("attempt")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("evidence_id"), F.col("event_id").alias("ord"), "ts", outcome.alias("outcome"))
    return in_parts(spark, rows, "lifecycle", lambda s: ordered.lifecycle(s, "ts", LATE))


@P.query(f"""
WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS spot FROM events WHERE {DUE})
SELECT event_type AS pool, CAST(spot // 20 AS INTEGER) AS "window", string_agg(event_id, ',' ORDER BY spot) AS ids FROM e GROUP BY 1, 2 HAVING count(*) = 20""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 events of a type, in the order of time."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("pool"), F.col("event_id").alias("ord"), "ts", F.col("event_id").cast("string").alias("evidence_id"))
    made = in_parts(spark, rows, "windows", lambda s: ordered.count_windows(s, "pool", "ts", 20, LATE))
    return made.select("pool", "window", F.array_join("evidence_ids", ",").alias("ids"))
