"""Evidence cards and the edits that cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: fields of an edit that are kept
PAYLOAD = ("op", "target", "content", "evidence_ids", "source_edit_ids", "source_type", "support_count", "merge_level", "failure_types", "patterns")


def edit_payload(edits: DataFrame) -> DataFrame:
    """Edits with the kept fields only; '' and empty lists become null."""
    kinds = dict(edits.dtypes)

    def kept(name: str) -> Column:
        if kinds[name].startswith("array"):
            return F.when(F.size(name) > 0, F.col(name))
        return F.nullif(F.col(name), F.lit("")) if kinds[name] == "string" else F.col(name)

    rest = [c for c in edits.columns if c not in PAYLOAD]
    return edits.select(*rest, *(kept(c).alias(c) for c in PAYLOAD if c in kinds))


def new_records(edits: DataFrame, epoch: int, order: str, status: str = "provisional") -> DataFrame:
    """Ledger records of new edits, with zeroed counters."""
    zeros = ("support_events", "non_improvement_streak", "reflection_attempts", "comparison_count")
    return edits.withColumns(
        {"status": F.lit(status), "introduced_epoch": F.lit(epoch), "introduced_order": F.col(order), **{z: F.lit(0) for z in zeros}}
    )


def with_outcomes(records: DataFrame, results: DataFrame, key: str = "task_id", order: str = "ord") -> DataFrame:
    """Records with the success and score of their task's last result."""
    last = results.groupBy(key).agg(F.max_by(F.struct("success", "score"), order).alias("__o"))
    return records.join(last, key, "left").select(*(records[c] for c in records.columns), F.col("__o.success").alias("success"), F.col("__o.score").alias("score"))


def judged(cards: DataFrame, decision: str = "decision") -> tuple[DataFrame, DataFrame]:
    """(kept cards, dropped ones): only 'keep', whatever its case, keeps a card."""
    keep = F.coalesce(F.lower(F.col(decision)) == "keep", F.lit(False))
    return cards.where(keep), cards.where(~keep)


def materialised(drafts: DataFrame, steps: DataFrame, *, key: str = "task_id", step: str = "step") -> tuple[DataFrame, DataFrame]:
    """(ranges with their steps as segments, ranges without any): drafts need evidence_id, nth, start, end."""
    met = drafts.join(steps.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & F.col(step).between(F.col("start"), F.col("end")), "left")
    rows = F.array_sort(F.collect_list(F.when(F.col("__key").isNotNull(), F.struct(step, "action", "observation"))))
    made = met.groupBy("evidence_id", "nth", key, "start", "end").agg(rows.alias("before_segment"))
    return made.where(F.size("before_segment") > 0), made.where(F.size("before_segment") == 0).drop("before_segment")


def public(cards: DataFrame) -> DataFrame:
    """Cards without the fields that only the engine uses (those that start with an underscore)."""
    return cards.drop(*(c for c in cards.columns if c.startswith("_")))


def linked(edits: DataFrame, window: DataFrame, edit_id: str = "edit_id") -> DataFrame:
    """Edits that cite a card of the window."""
    cited = edits.select(edit_id, F.explode("evidence_ids").alias("evidence_id"))
    hit = cited.join(window.select("evidence_id").distinct(), "evidence_id", "left_semi").select(edit_id).distinct()
    return edits.join(hit, edit_id, "left_semi")


def within_budget(edits: DataFrame, order: str, budget: int) -> DataFrame:
    """First edits in order; a budget of 0 or less takes all."""
    return edits.orderBy(order).limit(budget) if budget > 0 else edits


def origin_edits(edits: DataFrame, cards: DataFrame) -> DataFrame:
    """(edit_id, origin_edit_ids): origins of the cited cards, each where it is first met."""
    cited = edits.select("edit_id", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    origins = cited.join(cards.select("evidence_id", F.posexplode("origin_edit_ids").alias("nth", "origin")), "evidence_id").where(F.coalesce("origin", F.lit("")) != "")
    first = origins.groupBy("edit_id", "origin").agg(F.min(F.struct("at", "nth")).alias("o"))
    ordered = F.array_sort(F.collect_list(F.struct("o", "origin")))
    return first.groupBy("edit_id").agg(F.transform(ordered, lambda r: r["origin"]).alias("origin_edit_ids"))


def minibatches(records: DataFrame, success: Column, order: list[str], size: int = 4) -> DataFrame:
    """Records with their batch: failures and successes apart, ``size`` each, within a bundle."""
    kind = F.when(F.coalesce(success, F.lit(False)), "success").otherwise("failure")
    rows = records.withColumn("kind", kind)
    by = ["bundle", "kind"] if "bundle" in records.columns else ["kind"]
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("minibatch", F.concat_ws(":", F.col("kind"), F.floor(at / size).cast("string")))


def gate(before: int, after: int, allow_ties: bool = False) -> bool:
    """Whether a candidate passes validation: more hard successes than before (or as many, if ties pass)."""
    return after > before or (allow_ties and after == before)
