"""Comparison of two runs over the same tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.scalar import CATEGORIES, fixed, outcome


def last_wins(rows: DataFrame, key: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """One row per key, from its last row in order; an aggregate, so no task sorts a hot key."""
    top = F.max_by(F.struct(*(c.alias(n) for n, c in fields.items())), F.struct(*order))
    return rows.groupBy(key).agg(top.alias("__top")).select(key, "__top.*")


def longitudinal_pairs(items: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Items met on either side, with both sides' success, score and steps and the outcome class.

    ``before`` and ``after`` have one row per key. A missing side has not succeeded, with score and
    steps 0.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        made = [F.col(key)] + [F.col(c).alias(f"{name}_{c}") for c in ("success", "score", "steps")]
        return df.select(*made, F.lit(True).alias(f"has_{name}"))

    joined = items.join(side(before, "prev"), key, "left").join(side(after, "curr"), key, "left")
    joined = joined.where(F.col("has_prev").isNotNull() | F.col("has_curr").isNotNull())
    filled = {f"{s}_{c}": F.coalesce(f"{s}_{c}", F.lit(z)) for s in ("prev", "curr") for c, z in (("success", False), ("score", 0.0), ("steps", 0))}
    return joined.withColumns(filled).withColumn("category", outcome(F.col("prev_success"), F.col("curr_success"))).drop("has_prev", "has_curr")


def category_counts(pairs: DataFrame) -> DataFrame:
    """Count per category; the four known ones are there even with none."""
    domain = pairs.sparkSession.createDataFrame([(c, 0) for c in CATEGORIES], "category string, zero long")
    found = pairs.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("zero"))
    return domain.unionByName(found).groupBy("category").agg(F.sum("zero").alias("n"))


def comparison_text(pairs: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """The comparison as one report: counts, then regressions first and stable successes last.

    ``pairs`` needs id, task, task_family, category, the two sides' columns and, where wanted,
    prev_trajectory and curr_trajectory. A report is one text, so it is meant for one epoch's tasks;
    with ``by`` there is one for each group, after the group's columns.
    """
    has_text = {"prev_trajectory", "curr_trajectory"} <= set(pairs.columns)

    def mark(side: str) -> Column:
        passed = F.when(F.col(f"{side}_success"), "PASS").otherwise("FAIL")
        return F.format_string("%s (score=%s, steps=%d)", passed, fixed(F.col(f"{side}_score")), F.col(f"{side}_steps"))

    def shown(side: str, title: str) -> Column:
        if not has_text:
            return F.lit("")
        block = F.concat(F.lit(f"\n\n**{title} epoch trajectory:**\n```\n"), F.col(f"{side}_trajectory"), F.lit("\n```"))
        return F.when((F.col("category") != "stable_success") & (F.col(f"{side}_trajectory") != ""), block).otherwise("")

    family = F.when(F.coalesce("task_family", F.lit("")) != "", F.concat(F.lit("\nTask family: "), F.col("task_family"))).otherwise("")
    entry = F.concat(
        F.lit("\n#### Task "), F.col("id").cast("string"), F.lit(": "), F.substring(F.coalesce("task", F.lit("")), 1, 300), family,
        F.lit("\n- Previous epoch: "), mark("prev"), F.lit("\n- Current epoch: "), mark("curr"), shown("prev", "Previous"), shown("curr", "Current"),
    )
    # fixed values: titles of the report, in its order
    sections = [
        ("regressed", "Regressions (success -> fail) - HIGHEST PRIORITY"),
        ("persistent_fail", "Persistent Failures (fail -> fail)"),
        ("improved", "Improvements (fail -> success)"),
        ("stable_success", "Stable Successes (success -> success)"),
    ]
    heads = [
        ("improved", "Improved (fail -> success)"),
        ("regressed", "Regressed (success -> fail)"),
        ("persistent_fail", "Persistent failures (fail -> fail)"),
        ("stable_success", "Stable successes (success -> success)"),
    ]
    by = by or []
    rows = pairs.select(*by, "category", F.struct(F.col(order).alias("ord"), entry.alias("text")).alias("entry"))
    made = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("entry")))).alias(c) for c in CATEGORIES),
    )
    summary = F.concat(
        F.lit("## Longitudinal Comparison Summary\nTotal samples: "), F.col("total").cast("string"), F.lit("\n"),
        *(x for c, t in heads for x in (F.lit(f"- {t}: "), F.size(c).cast("string"), F.lit("\n"))),
    )
    parts = [summary]
    for c, title in sections:
        body = F.concat(F.lit(f"### {title}\n"), F.array_join(F.transform(c, lambda e: e["text"]), "\n"))
        parts.append(F.when(F.size(c) > 0, body).otherwise(f"### {title}\n(none)\n"))
    return made.select(*by, F.concat_ws("\n\n", *parts).alias("report"))
