"""Trajectories: step selection, history, transitions, run lengths, text forms, step ranges.

A trajectory is either an array of step structs in one row or one row per step; both forms are
served. Row forms take the task key and an explicit order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions import text as X
from tracequarry.functions.scalar import last_n
from tracequarry.operators import scan


def select_steps(steps: Column, mode: str = "prefix", limit: int = 24, head: int = 1, tail: int = 8) -> Column:
    """Steps of an array: 'full', 'prefix', 'tail', or 'head_tail' (each step number once, first wins)."""
    if mode == "full":
        return steps
    if mode == "prefix":
        return F.slice(steps, 1, max(0, limit))
    if mode == "tail":
        return last_n(steps, max(0, limit))
    if mode != "head_tail":
        raise ValueError(f"unknown mode {mode}")
    both = F.concat(F.slice(steps, 1, max(0, head)), last_n(steps, max(0, tail)))
    return F.filter(
        both,
        lambda s, i: ~F.exists(F.slice(both, F.lit(1), i), lambda o: o["step"].eqNullSafe(s["step"])),
    )


def ranked(steps: DataFrame, key: str, order: list[str], most: int = scan.MOST) -> DataFrame:
    """Rows with their position from the start (``rn``) and from the end (``rev``)."""
    return scan.ranked(steps, key, order, most)


def step_rows(steps: DataFrame, key: str, order: list[str], mode: str, limit: int = 24, head: int = 1, tail: int = 8, most: int = scan.MOST) -> DataFrame:
    """Row form of ``select_steps``."""
    if mode == "full":
        return steps
    rows = ranked(steps, key, order, most)
    if mode == "prefix":
        rows = rows.where(F.col("rn") <= limit)
    elif mode == "tail":
        rows = rows.where(F.col("rev") <= limit)
    elif mode == "head_tail":
        rows = rows.where((F.col("rn") <= head) | (F.col("rev") <= tail))
    else:
        raise ValueError(f"unknown mode {mode}")
    return rows.drop("rn", "rev")


def replay_prefix(steps: Column, start: Column | int) -> Column:
    """Steps before the start of a replay."""
    return F.filter(steps, lambda s: s["step"] < start)


def normal_record(results: DataFrame, *, limit: int = 24, chars: int = 1500, mode: str = "prefix", action_only: bool = False, head: int = 1, tail: int = 8) -> DataFrame:
    """Canonical task records: resolved id, instruction, reward and family, sliced and clipped steps."""
    from tracequarry.functions import resolve

    fields = results.schema["trajectory"].dataType.elementType.fieldNames()

    def reward(s: Column) -> Column:
        return F.coalesce(*(s[n].cast("double") for n in ("score_delta", "reward", "score") if n in fields), F.lit(0.0))

    def step(s: Column) -> Column:
        seen = F.lit("") if action_only else X.compact(s["observation"], chars)
        return F.struct(
            s["step"].cast("int").alias("step"), seen.alias("observation"), F.coalesce(s["action"], F.lit("")).alias("action"), reward(s).alias("reward")
        )

    steps = select_steps(F.coalesce("trajectory", F.array().cast(results.schema["trajectory"].dataType)), mode, limit, head, tail)
    return results.select(
        resolve.task_id(results).alias("task_id"),
        X.compact(resolve.instruction(results), chars).alias("instruction"),
        F.transform(steps, step).alias("trajectory"),
        resolve.final_reward(results).alias("final_reward"),
        resolve.family(results).alias("task_family"),
    )


def without_rewards(records: DataFrame) -> DataFrame:
    """Records without reward columns at either level."""
    dropped = F.transform("trajectory", lambda s: s.dropFields("reward"))
    return records.withColumn("trajectory", dropped).drop("final_reward", "observed_reward")


def history(steps: DataFrame, key: str, order: str, value: Column, size: int = 8, most: int = scan.MOST) -> DataFrame:
    """Rows with the values of the ``size`` rows before them, oldest first."""
    return scan.history(steps, key, [order], value, size, most=most)


def transitions(steps: DataFrame, key: str, order: str, score: str, places: int = 10, most: int = scan.MOST) -> DataFrame:
    """Rows with score_before, score_after and their rounded difference; null where a side is missing."""
    rows = scan.lagged(steps, key, [order], F.col(score), "score_before", most)
    return rows.withColumns({"score_after": F.col(score), "score_delta": F.round(F.col(score) - F.col("score_before"), places)})


def run_lengths(steps: DataFrame, key: str, order: str, action: str, limit: int = 12, most: int = scan.MOST) -> DataFrame:
    """(key, sequence): actions of a key in order, equal neighbours as 'a xN', joined by arrows.

    Blank actions don't count; of more than ``limit`` the first are kept and a mark is added.
    """
    named = steps.select(key, order, X.squeeze(action).alias("action")).where("action <> ''")
    w = Window.partitionBy(key).orderBy("rn")  # over ``limit`` rows a key at most
    rows = ranked(named, key, [order], most).withColumn("total", F.col("rn") + F.col("rev") - 1).where(F.col("rn") <= limit)
    rows = rows.withColumn("new", F.coalesce((F.lag("action").over(w) != F.col("action")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    runs = rows.groupBy(key, "run").agg(F.first("action").alias("action"), F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    said = F.when(F.col("n") > 1, F.concat("action", F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col("action"))
    ordered = F.array_sort(F.collect_list(F.struct("run", said.alias("said"))))
    return runs.groupBy(key).agg(ordered.alias("runs"), F.max("total").alias("total")).select(
        key,
        F.concat(
            F.array_join(F.transform("runs", lambda r: r["said"]), " -> "),
            F.when(F.col("total") > limit, " -> [truncated]").otherwise(""),
        ).alias("sequence"),
    )


def segment_runs(segments: Column, limit: int = 12) -> Column:
    """Actions of several segments (arrays of steps) in run-length form, one after the other.

    Each segment is sorted by step, of equal steps the first first, cleaned of blank actions and cut at
    ``limit``. Of several segments each is numbered from 1.
    """

    def runs(steps: Column) -> Column:
        numbered = F.transform(steps, lambda s, i: F.struct(s["step"].alias("step"), i.alias("i"), X.squeeze(s["action"]).alias("action")))
        actions = F.transform(F.filter(F.array_sort(numbered), lambda s: s["action"] != ""), lambda s: s["action"])
        kept = F.slice(actions, 1, limit)
        empty = F.array().cast("array<struct<a:string,n:int>>")

        def add(acc: Column, a: Column) -> Column:
            last = F.element_at(acc, -1)
            again = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), (last["n"] + 1).alias("n"))))
            new = F.concat(acc, F.array(F.struct(a.alias("a"), F.lit(1).alias("n"))))
            return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["a"] == a), again).otherwise(new)

        counted = F.aggregate(kept, empty, add)
        said = F.transform(counted, lambda r: F.when(r["n"] > 1, F.concat(r["a"], F.lit(" x"), r["n"].cast("string"))).otherwise(r["a"]))
        return F.array_join(F.when(F.size(actions) > limit, F.concat(said, F.array(F.lit("[truncated]")))).otherwise(said), " -> ")

    several = F.size(segments) > 1
    parts = F.transform(segments, lambda s, i: F.struct((i + 1).alias("i"), runs(s).alias("t")))
    parts = F.filter(parts, lambda p: p["t"] != "")
    return F.array_join(F.transform(parts, lambda p: F.when(several, F.concat(F.lit("segment "), p["i"].cast("string"), F.lit(": "), p["t"])).otherwise(p["t"])), "\n")


def legacy_record(results: DataFrame) -> DataFrame:
    """Canonical records under their former limits and name of the reward."""
    return normal_record(results, limit=24, chars=1500).withColumnRenamed("final_reward", "observed_reward")


def compact_text(steps: Column, limit: int = 3000, full: bool = False) -> Column:
    """A trajectory as lines of thought, observation, action and what came next, cut in the middle."""

    def say(s: Column, name: str, n: int) -> Column:
        value = F.coalesce(s[name], F.lit(""))
        return value if full else X.clip(value, n)

    def lines(s: Column) -> Column:
        head = F.concat(F.lit("[step "), F.coalesce(s["step"].cast("string"), F.lit("?")))
        thought, after = say(s, "thought", 300), say(s, "next_observation", 700)
        return F.array_compact(
            F.array(
                F.when(thought != "", F.concat(head, F.lit(" think] "), thought)),
                F.concat(head, F.lit(" obs] "), say(s, "observation", 700)),
                F.concat(head, F.lit(" action] "), say(s, "action", 200)),
                F.when(after != "", F.concat(head, F.lit(" next_obs] "), after)),
            )
        )

    out = F.array_join(F.flatten(F.transform(steps, lines)), "\n")
    out = F.when(F.coalesce(out, F.lit("")) == "", "(empty trajectory)").otherwise(out)
    return out if full else X.cut_middle(out, limit)


def embedding_text(pattern: Column, op: Column, target: Column, content: Column, reason: int = 300) -> Column:
    """Labelled lines of an evidence card; a line without a value is left out."""
    named = [("pattern", X.shorten(pattern, reason)), ("edit_op", X.squeeze(op)), ("edit_target", X.squeeze(target)), ("edit_content", X.squeeze(content))]
    lines = F.array(*(F.when(v != "", F.concat(F.lit(f"{k}: "), v)) for k, v in named))
    return F.array_join(F.array_compact(lines), "\n")


def range_segments(ranges: DataFrame, steps: DataFrame, *, key: str = "task_id", step: str = "step") -> DataFrame:
    """Steps of each range [start, end] of its task: an equi-join with a range condition."""
    s = steps.withColumnRenamed(key, "__key")
    return ranges.join(s, (F.col(key) == F.col("__key")) & F.col(step).between(F.col("start"), F.col("end"))).drop("__key")
