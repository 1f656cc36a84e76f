"""Evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarise(results: DataFrame, success: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """tasks, avg_score and success_rate per group; without groups an empty input gives zeros."""
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.avg(success.cast("double")), F.lit(0.0)).alias("success_rate"),
    )


def rollout_summary(results: DataFrame, success: Column, score: Column, steps: Column, by: list[str] | None = None) -> DataFrame:
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("score_avg"),
        F.coalesce(F.sum(success.cast("long")), F.lit(0)).alias("successes"),
        F.coalesce(F.avg(success.cast("double")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(steps.cast("double")), F.lit(0.0)).alias("steps_avg"),
    )


def scenario_completion(results: DataFrame, scenario: list[str], success: Column, size: int = 3, by: list[str] | None = None) -> DataFrame:
    """Scenarios with exactly ``size`` results that all succeeded, in percent, beside the task rate."""
    each = results.groupBy(*(by or []), *scenario).agg(
        F.count(F.lit(1)).alias("n"), F.sum(success.cast("long")).alias("good"), F.bool_and(success).alias("whole")
    )
    done = ((F.col("n") == size) & F.col("whole")).cast("double")
    return each.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.coalesce(100 * F.avg(done), F.lit(0.0)).alias("scenario_completion"),
        F.coalesce(100 * F.sum("good") / F.sum("n"), F.lit(0.0)).alias("task_completion"),
    )


def scenario_completion_of(results: DataFrame, dataset: str, success: Column, *, only: str = "appworld") -> DataFrame:
    """Scenario completion where every row is of the benchmark that has scenarios; else no row.

    A scenario is the row's family, else its id without the last part.
    """
    family = F.coalesce(F.nullif(F.col("task_family"), F.lit("")), F.regexp_replace(F.col("task_id"), "_[^_]*$", ""))
    foreign = F.sum((~F.coalesce(F.lower(dataset) == only, F.lit(False))).cast("long"))
    mixed = results.agg(foreign.alias("foreign"), F.count(F.lit(1)).alias("rows")).where("foreign = 0 and rows > 0").select(F.lit(True).alias("__whole"))
    made = scenario_completion(results.withColumn("__scenario", family), ["__scenario"], success)
    return made.join(F.broadcast(mixed)).drop("__whole")


def mode_sums(results: DataFrame, logs: DataFrame, success: Column, score: Column) -> DataFrame:
    """Summary of each mode, beside the sums of accepted and committed edits over all bundle logs.

    ``logs`` has a struct l2 with accepted_count and committed_count; missing ones count 0.
    """
    edits = logs.agg(
        F.coalesce(F.sum("l2.accepted_count"), F.lit(0)).cast("long").alias("accepted_edits"),
        F.coalesce(F.sum("l2.committed_count"), F.lit(0)).cast("long").alias("committed_edits"),
    )
    named = results.withColumn("mode", F.coalesce(F.col("mode").cast("string"), F.lit("")))
    return summarise(named, success, score, ["mode"]).join(F.broadcast(edits))  # one row


def low_reward_ids(results: DataFrame, task: str, reward: str, threshold: float = 1.0) -> DataFrame:
    """Rows with an id and a reward under the threshold; repeated rows stay."""
    return results.where(F.col(task).isNotNull() & (F.col(reward) < threshold)).select(F.col(task).cast("string").alias("task_id"))


def counts(rows: DataFrame, key: Column | str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def enrich(results: DataFrame, **defaults: Column) -> DataFrame:
    """Set columns only where they are missing or null."""
    return results.withColumns({k: F.coalesce(F.col(k), v) if k in results.columns else v for k, v in defaults.items()})
