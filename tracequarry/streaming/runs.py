"""Structured Streaming counterparts: progress by bundle, running summaries, evidence lifecycle.

Every function takes and returns a streaming (or, for tests, batch-started) DataFrame; sinks get a
checkpoint folder, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_summary(results: DataFrame) -> DataFrame:
    """tasks, avg_score and success_rate per mode so far; for output mode 'update' or 'complete'."""
    good = F.coalesce(F.col("success"), F.lit(False)) | (F.coalesce("score", F.lit(0.0)) >= 1)
    return results.groupBy("mode").agg(
        F.count(F.lit(1)).alias("tasks"), F.avg("score").alias("avg_score"), F.avg(good.cast("double")).alias("success_rate")
    )


def windowed_rewards(steps: DataFrame, time: str, size: str = "10 minutes", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Steps and reward per time window; rows later than ``late`` are left out, closed windows go."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        steps.withWatermark(time, late)
        .groupBy(window.alias("w"))
        .agg(F.count(F.lit(1)).alias("steps"), F.sum("reward").alias("reward"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "steps", "reward")
    )


def write_bundles(results: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Results written by bundle and micro-batch; a batch that is run again replaces its own rows.

    A bundle may come in several micro-batches: each has a folder of its own below the bundle's.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bundle", "batch").parquet(path)

    writer = results.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_bundles`` wrote, as it came."""
    return spark.read.parquet(path).drop("batch")


def in_order(batches: Iterator[pd.DataFrame], order: str = "ord") -> pd.DataFrame:
    """All rows of a key in one micro-batch, in order, however many Arrow batches they come in."""
    parts = list(batches)
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame()


def kept_running(start: Callable[[], StreamingQuery], tries: int = 5, wait: float = 1.0) -> int:
    """Start a query and start it again when it fails, up to ``tries`` times; returns the restarts.

    Its checkpoint folder makes it go on where it stopped.
    """
    for n in range(tries + 1):
        try:
            start().awaitTermination()
            return n
        except Exception:
            if n == tries:
                raise
            time.sleep(wait * 2**n)
    return tries


def lifecycle(events: DataFrame, max_rejects: int = 2) -> DataFrame:
    """(evidence_id, attempts, rejects, status): state of each card after its events so far.

    Events have evidence_id and outcome ('attempt', 'reject', 'accept' or 'reactivate'). A card
    rejected ``max_rejects`` times is stale, an accepted one archived, a reactivated one active. Within
    a micro-batch they count in the order of ``ord``. State is one small row a card and stays, since
    any card can come back.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, rejects, status = state.get if state.exists else (0, 0, "active")
        for outcome in in_order(batches).get("outcome", []):
            attempts += outcome in ("attempt", "reject", "accept")
            if outcome == "reject":
                rejects += 1
                status = "stale" if rejects >= max_rejects else status
            elif outcome == "accept":
                status = "archived"
            elif outcome == "reactivate":
                rejects, status = 0, "active"
        state.update((attempts, rejects, status))
        yield pd.DataFrame({"evidence_id": [key[0]], "attempts": [attempts], "rejects": [rejects], "status": [status]})

    return events.groupBy("evidence_id").applyInPandasWithState(
        update,
        "evidence_id string, attempts int, rejects int, status string",
        "attempts int, rejects int, status string",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def count_windows(cards: DataFrame, pool: str, size: int) -> DataFrame:
    """(pool, window, evidence_ids): a window whenever ``size`` cards of a pool have come.

    State holds fewer than ``size`` ids per pool.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, waiting = state.get if state.exists else (0, [])
        waiting, out = list(waiting), []
        waiting += list(in_order(batches).get("evidence_id", []))
        while len(waiting) >= size:
            out.append((key[0], made, waiting[:size]))
            made, waiting = made + 1, waiting[size:]
        state.update((made, waiting))
        yield pd.DataFrame(out, columns=["pool", "window", "evidence_ids"])

    return cards.groupBy(pool).applyInPandasWithState(
        update, "pool string, window int, evidence_ids array<string>", "made int, waiting array<string>", "append", GroupStateTimeout.NoTimeout
    )
