"""Logical fields from rows whose names vary, as column expressions.

Only the columns that a table has take part, so one expression serves every benchmark's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.text import or_else

# fixed values: names under which a field may come, first that says something wins
TASK_ID = ("task_id", "id", "task")
FAMILY = ("task_family", "family", "task_type")
INSTRUCTION = ("instruction", "task", "task_name", "question")


def first_text(df: DataFrame, names: tuple[str, ...], default: str | None = None) -> Column:
    """First of the columns that is neither null nor ''."""
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return or_else(*found, F.lit(default))


def task_id(df: DataFrame) -> Column:
    return first_text(df, TASK_ID)


def family(df: DataFrame) -> Column:
    return first_text(df, FAMILY, "other")


def instruction(df: DataFrame) -> Column:
    return first_text(df, INSTRUCTION, "")


def number(df: DataFrame, names: tuple[str, ...], default: float = 0.0) -> Column:
    found = [F.col(n).cast("double") for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default))


def step_reward(df: DataFrame) -> Column:
    """Reward of a step. On typed columns a missing field is null, so the next name is tried."""
    return number(df, ("score_delta", "reward", "score"))


def variant_step_reward(raw: Column) -> Column:
    """Reward of a step in a VARIANT, where a present null ends the search and counts as 0."""
    out = F.lit(0.0)
    for name in ("score", "reward", "score_delta"):
        value = F.variant_get(raw, f"$.{name}", "variant")
        out = F.when(value.isNotNull(), F.coalesce(F.try_variant_get(raw, f"$.{name}", "double"), F.lit(0.0))).otherwise(out)
    return out


def final_reward(df: DataFrame, *, reloaded: bool = False) -> Column:
    return number(df, ("final_reward", "observed_reward", "reward_before") if reloaded else ("final_reward", "score"))


def succeeded(df: DataFrame) -> Column:
    """Flag, or a score (else final reward) of 1 or more."""
    return flagged(df) | (number(df, ("score", "final_reward")) >= 1)


def scored_success(df: DataFrame) -> Column:
    """Flag, or a score of 1 or more; the final reward doesn't count."""
    return flagged(df) | (number(df, ("score",)) >= 1)


def flagged(df: DataFrame) -> Column:
    return F.coalesce(F.col("success").cast("boolean"), F.lit(False)) if "success" in df.columns else F.lit(False)


def step_count(df: DataFrame) -> Column:
    found = [F.col("steps").cast("int")] if "steps" in df.columns else []
    found += [F.nullif(F.size("trajectory"), F.lit(-1))] if "trajectory" in df.columns else []
    return F.coalesce(*found, F.lit(0))


def positive_int(value: Column) -> Column:
    """A whole number over 0; null for anything else."""
    n = value.cast("string").try_cast("int")
    return F.when(n > 0, n)


def scenario_ref(df: DataFrame) -> DataFrame:
    """Task references of the benchmark with scenarios: id, family and variant; an id without a variant fails the query."""
    name = first_text(df, ("task_id", "id"), "")
    found = F.regexp_extract(name, "^(.*)_([^_]*)$", 1)
    variant = F.regexp_extract(name, "^(.*)_([^_]*)$", 2).try_cast("int")
    given = F.col("variant").cast("int") if "variant" in df.columns else F.lit(None).cast("int")
    checked = F.when(variant.isNull(), F.raise_error(F.concat(F.lit("invalid task id "), name))).otherwise(name)
    return df.select(
        checked.alias("task_id"), or_else(first_text(df, ("task_family",)), found).alias("task_family"), F.coalesce(given, variant).alias("variant")
    )


def science_ref(df: DataFrame) -> DataFrame:
    """Task references of the benchmark with variations: id, task, family, variation, simplification and step limit."""
    from tracequarry.functions.text import science_family, strip

    task = first_text(df, ("task", "task_name", "instruction"), "")
    family = or_else(strip(F.coalesce(first_text(df, ("task_family", "family")), F.lit(""))), science_family(task), F.lit("scienceworld"))
    steps = F.col("recommended_max_steps") if "recommended_max_steps" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.coalesce(first_text(df, ("task_id", "id", "task", "task_name", "instruction")), F.lit("")).alias("task_id"),
        task.alias("task"),
        family.alias("task_family"),
        number(df, ("variation_idx", "variation")).cast("int").alias("variation_idx"),
        F.coalesce(first_text(df, ("simplification", "simplification_str")), F.lit("")).alias("simplification"),
        positive_int(steps).alias("recommended_max_steps"),
    )


def info_score(info: Column, fallback: float = 0.0) -> Column:
    """The score in a JSON info; the fallback where there is none or it is no number, 0 for a null one."""
    v = F.try_parse_json(info)
    there = F.try_variant_get(v, "$.score", "variant").isNotNull()
    empty = F.coalesce(F.try_variant_get(v, "$.score", "string"), F.lit("")) == ""
    return F.when(there & empty, 0.0).otherwise(F.coalesce(F.try_variant_get(v, "$.score", "double"), F.lit(float(fallback))))
