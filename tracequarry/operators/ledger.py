"""Edits and evidence: coalescing, ids, pool state, selection, comparison jobs.

Order is a column (``ord``) throughout. Keys that lists are gathered for (one edit's ids, one
card's ranges) are bounded by what one record holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions.text import strip
from tracequarry.session import staged

CLOSED = ("superseded", "removed", "validated")
REOPENED = ("unresolved", "needs_correction")


def distinct_in_order(*lists: Column) -> Column:
    """Values of several arrays in the order first met, trimmed, blanks dropped."""
    parts = [F.coalesce(x, F.array().cast("array<string>")) for x in lists]
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), lambda v: strip(v)), lambda v: F.coalesce(v, F.lit("")) != ""))


def identity(op: str, target: str, content: str) -> list[Column]:
    """What makes two edits the same."""
    blank = F.lit("")
    return [
        F.lower(strip(F.coalesce(F.col(op), blank))).alias("key_op"),
        strip(F.coalesce(F.col(target), blank)).alias("key_target"),
        strip(F.coalesce(F.col(content), blank)).alias("key_content"),
    ]


#: Lists of an edit that are united when edits are merged.
UNITED = ("evidence_ids", "source_edit_ids", "failure_types", "patterns")


def identity_hash(edits: DataFrame) -> DataFrame:
    """``edits`` with k1 and k2, a 128-bit hash of what makes an edit the same; without an op each is its own."""
    op, target, content = identity("op", "target", "content")
    same = [op, target, content, F.when(F.coalesce(op, F.lit("")) == "", F.col("ord").cast("string"))]
    return edits.withColumns({"k1": F.xxhash64(*same), "k2": F.xxhash64(F.lit(11), *same)})


def coalesce_edits(edits: DataFrame) -> DataFrame:
    """Equal edits as one: the first stays, lists are united in the order first met, counts are the largest.

    Needs ord, edit_id, op, target, content, evidence_ids, source_type, support_count, merge_level; may
    have source_edit_ids, failure_types, patterns and candidate_id. An edit without an op is never
    merged. Source types that differ give 'mixed'. Candidates of merged edits join source_edit_ids
    after the sources. Lists are united by value before they are gathered, so a row grows with its
    distinct values, not with the copies of its edit.
    """
    keyed = identity_hash(edits)
    lists = [c for c in UNITED if c in edits.columns]
    has_candidate = "candidate_id" in edits.columns
    rows = keyed.groupBy("k1", "k2").agg(
        F.min("ord").alias("ord"),
        F.min_by(F.struct("edit_id", "op", "target", "content"), "ord").alias("first"),
        F.max("support_count").alias("support_count"),
        F.max("merge_level").alias("merge_level"),
        F.collect_set(F.nullif(strip(F.col("source_type")), F.lit(""))).alias("types"),
        F.count(F.lit(1)).alias("n"),
    )

    def entry(name: str, after: int, at: Column, v: Column) -> Column:
        return F.struct(F.lit(name).alias("list"), F.lit(after).alias("after"), at.alias("at"), v.alias("v"))

    def entries(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda v, i: entry(name, 0, i, v))

    said = [*(entries(c) for c in lists), F.array(entry("merged_from", 0, F.lit(0), F.col("edit_id")))]
    if has_candidate:
        said.append(F.array(entry("source_edit_ids", 1, F.lit(0), F.col("candidate_id"))))
    each = keyed.select("k1", "k2", "ord", F.explode(F.concat(*said)).alias("s")).select("k1", "k2", "s.list", strip(F.col("s.v")).alias("v"), F.struct("s.after", "ord", "s.at").alias("o"))
    first = each.where(F.coalesce("v", F.lit("")) != "").groupBy("k1", "k2", "list", "v").agg(F.min("o").alias("o"))
    ordered = F.array_sort(F.collect_list(F.struct("o", "v")))
    found = [*dict.fromkeys([*lists, *(["source_edit_ids"] if has_candidate else []), "merged_from"])]
    united = first.groupBy("k1", "k2").pivot("list", found).agg(ordered)
    met = rows.join(united, ["k1", "k2"], "left")

    def values(name: str) -> Column:
        held = F.coalesce(F.col(name), F.array().cast(dict(united.dtypes)[name]))
        if name == "source_edit_ids":  # an edit that met no other keeps its sources as they are
            held = F.filter(held, lambda r: (F.col("n") > 1) | (r["o"]["after"] == 0))
        return F.transform(held, lambda r: r["v"])

    kind = F.when(F.size("types") > 1, "mixed").otherwise(F.get("types", F.lit(0)))
    return met.select(
        "ord", "first.*", *(values(c).alias(c) for c in found if c != "merged_from"), kind.alias("source_type"), "support_count", "merge_level",
        F.when(F.col("n") > 1, values("merged_from")).alias("merged_from"),
    )


def coalesce_ledger(records: DataFrame) -> DataFrame:
    """Ledger records of equal edits as one: events add up, streaks take the largest.

    The first record's status stays unless a later one is open again.
    """
    keyed = records.select("*", *identity("op", "target", "content")).withColumn("solo", F.when(F.col("key_op") == "", F.col("ord")))
    grouped = keyed.withColumn("reopened", F.when(F.col("status").isin(*REOPENED), F.col("ord"))).groupBy("key_op", "key_target", "key_content", "solo")
    rows = grouped.agg(
        F.min("ord").alias("ord"),
        F.min_by(F.struct("edit_id", "op", "target", "content", "status"), "ord").alias("first"),
        F.max_by("status", "reopened").alias("later"),
        F.max("reopened").alias("last_open"),
        F.sum(F.coalesce("support_events", F.lit(0))).alias("support_events"),
        F.sum(F.coalesce("comparison_count", F.lit(0))).alias("comparison_count"),
        F.max(F.coalesce("non_improvement_streak", F.lit(0))).alias("non_improvement_streak"),
        F.max(F.coalesce("reflection_attempts", F.lit(0))).alias("reflection_attempts"),
    )
    status = F.when(F.col("last_open") > F.col("ord"), F.col("later")).otherwise(F.col("first.status"))
    return rows.select(
        "ord", "first.edit_id", "first.op", "first.target", "first.content", status.alias("status"),
        "support_events", "comparison_count", "non_improvement_streak", "reflection_attempts",
    )


def live(records: DataFrame) -> DataFrame:
    return records.where(~F.coalesce("status", F.lit("")).isin(*CLOSED))


def ids_in_order(rows: DataFrame, ids: str, order: list[str]) -> DataFrame:
    """(id, ord): distinct ids of array columns, by where they are first met."""
    each = rows.select(F.struct(*order).alias("o"), F.posexplode(ids).alias("at", "id")).where(F.coalesce("id", F.lit("")) != "")
    return each.groupBy("id").agg(F.min(F.struct("o", "at")).alias("first"))


def assign_ids(rows: DataFrame, id_col: str, prefix: str, start: int, order: str) -> DataFrame:
    """Ids like E000007 where missing, in order; those present stay and use up no number.

    Numbers run over the whole input: ranks within ranges of the order, plus the ranges' offsets.
    """
    needs = (F.coalesce(F.col(id_col), F.lit("")) == "").cast("long")
    dealt = staged(
        rows.withColumn("__needs", needs).repartitionByRange(order).withColumn("__block", F.spark_partition_id()), "assigned"
    )
    ahead = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = dealt.groupBy("__block").agg(F.sum("__needs").alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    inside = F.sum("__needs").over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    number = F.format_string(f"{prefix}%06d", F.col("__ahead") + inside + start - 1)
    met = dealt.join(F.broadcast(offsets), "__block")  # as many rows as partitions
    return met.withColumn(id_col, F.when(F.col("__needs") == 1, number).otherwise(F.col(id_col))).drop("__needs", "__block", "__ahead")


def pool_counts(cards: DataFrame) -> DataFrame:
    """Cards per status; archived ones count as such."""
    status = F.when(F.coalesce("archived", F.lit(False)), "archived").otherwise(F.coalesce("l2_status", F.lit("active")))
    return cards.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def reactivate(cards: DataFrame, ids: DataFrame, id_col: str = "evidence_id") -> DataFrame:
    """Cards with the named ones active again, their reasons cleared; ``changed`` marks them."""
    named = ids.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull() & (F.col("__id").cast("string") != "")).distinct().withColumn("__hit", F.lit(True))
    hit = F.coalesce("__hit", F.lit(False))
    sets = {
        "archived": F.when(hit, False).otherwise(F.col("archived")),
        "l2_status": F.when(hit, "active").otherwise(F.col("l2_status")),
        "archive_reason": F.when(~hit, F.col("archive_reason")),
        "consume_reason": F.when(~hit, F.col("consume_reason")),
        "defer_reason": F.when(hit, "origin_edit_removed").otherwise(F.col("defer_reason")),
    }
    out = cards.join(named, F.col(id_col) == F.col("__id"), "left").withColumn("changed", hit)
    return out.withColumns({k: v for k, v in sets.items() if k in cards.columns}).drop("__id", "__hit")


def archive(cards: DataFrame, ids: DataFrame, reason: str = "archived", id_col: str = "evidence_id") -> DataFrame:
    """Cards with the named ones marked as archived; their reason is set where they had none."""
    named = ids.select(F.col(id_col).alias("__id")).distinct()
    hit = F.col("__id").isNotNull()
    out = cards.join(named, F.col(id_col) == F.col("__id"), "left").withColumns(
        {
            "archived": F.when(hit, True).otherwise(F.coalesce("archived", F.lit(False))),
            "archive_reason": F.when(hit, F.coalesce("archive_reason", F.lit(reason))).otherwise(F.col("archive_reason")),
        }
    )
    return out.drop("__id")


def recent(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The last rows in order, oldest first; none for n of 0 or less."""
    last = rows.orderBy(*(F.desc(c) for c in order)).limit(max(0, n))
    return last.orderBy(*order)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def select_window(cards: DataFrame, size: int) -> DataFrame:
    """Active cards for one editor call: least tried first, then oldest. (This rule is ours.)"""
    return cards.where(~F.coalesce("archived", F.lit(False))).orderBy(F.coalesce("attempts", F.lit(0)), "ord").limit(size)


def mark_attempts(cards: DataFrame, tried: DataFrame, rejected: DataFrame, max_rejects: int = 2, id_col: str = "evidence_id") -> DataFrame:
    """Attempts and rejects counted up; a card rejected ``max_rejects`` times goes stale."""
    t = tried.select(F.col(id_col).alias("__t")).distinct()
    r = rejected.select(F.col(id_col).alias("__r")).distinct()
    out = cards.join(t, F.col(id_col) == F.col("__t"), "left").join(r, F.col(id_col) == F.col("__r"), "left")
    rejects = F.coalesce("rejects", F.lit(0)) + F.col("__r").isNotNull().cast("int")
    return out.withColumns(
        {
            "attempts": F.coalesce("attempts", F.lit(0)) + F.col("__t").isNotNull().cast("int"),
            "rejects": rejects,
            "l2_status": F.when(F.col("__r").isNotNull() & (rejects >= max_rejects), "stale").otherwise(F.col("l2_status")),
        }
    ).drop("__t", "__r")


def job_spans(edits: DataFrame, cards: DataFrame) -> DataFrame:
    """One row for each edit, card and trigger range: what ``comparison_jobs`` ranks, with the places of card and range."""
    wanted = edits.select("edit_id", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    ranges = cards.select(
        "evidence_id", F.coalesce("support_count", F.lit(1)).alias("support_count"), "supporting_tasks", F.posexplode("trigger_ranges").alias("nth", "r")
    ).where(F.coalesce("r.task_id", F.lit("")) != "")
    family = F.get(F.reverse(F.filter("supporting_tasks", lambda t: t["task_id"] == F.col("r.task_id"))), F.lit(0))["task_family"]
    return wanted.join(ranges, "evidence_id").select(
        "edit_id", F.col("r.task_id").alias("task_id"), F.coalesce(family, F.lit("")).alias("task_family"), "evidence_id",
        F.col("r.start").alias("start"), F.col("r.end").alias("end"), "support_count", "at", "nth",
    )


def comparison_jobs(edits: DataFrame, cards: DataFrame) -> DataFrame:
    """(edit_id, task_id, task_family, evidence_id, start, end, support_count, rn): replay jobs per edit.

    An edit's cards and their trigger ranges, best supported first. ``edits`` needs edit_id and
    evidence_ids; ``cards`` evidence_id, support_count, trigger_ranges and supporting_tasks.
    """
    order = Window.partitionBy("edit_id").orderBy(F.desc("support_count"), "task_family", "task_id", "at", "nth")
    return job_spans(edits, cards).withColumn("rn", F.row_number().over(order)).drop("at", "nth")


def picked_tasks(jobs: DataFrame, edits: DataFrame, by: str, seed: int, limit: int = 20) -> DataFrame:
    """(by, place, task_id, edit_id, evidence_id, start, end, support_count, origin_edit_ids): the tasks each list compares.

    The rule picks one after the other, but needs no loop. First each edit, in order, asks for the task of
    its best job: the tasks taken are those first asked for, up to ``limit``, and the edits that asked for
    them are covered. Then jobs come in the order of (not covered first, support, family, task, edit, lot):
    the tasks added are the first new ones of that order, and it ends with the one that fills the list. So
    both steps are the least places of tasks, and edits join a task for each job up to that end.

    ``jobs`` are rows of ``comparison_jobs``, ``edits`` has ``by``, edit_id (each in one list) and ord. A
    list without jobs has no rows. Places count from 0. Ranks are over tasks of a list and keep ``limit``.
    """
    limit = max(0, limit)
    own = jobs.join(edits.select(by, "edit_id", F.col("ord").alias("turn")), "edit_id")
    job = F.struct("edit_id", "evidence_id", "start", "end", "support_count")
    top = own.where("rn = 1")
    asked = top.groupBy(by, "task_id").agg(F.min(F.struct("turn", job.alias("job"))).alias("first"))
    spot = F.row_number().over(Window.partitionBy(by).orderBy("first.turn", "first.job.edit_id"))
    taken = asked.withColumn("place", spot).where(F.col("place") <= limit)
    taken = staged(taken.select(by, "task_id", (F.col("place") - 1).alias("place"), "first.job"), "picked")
    covering = top.join(taken.select(by, "task_id"), [by, "task_id"])
    covered = covering.select("edit_id", F.lit(1).alias("covered")).distinct()
    shuffled = F.sha2(F.concat_ws(":", F.lit(str(seed)), "edit_id", "task_id", F.col("rn").cast("string")), 256)
    rank = F.struct(F.coalesce("covered", F.lit(0)).alias("covered"), (-F.col("support_count")).alias("less"), "task_family", "task_id", "edit_id", shuffled.alias("lot"))
    rest = staged(own.join(covered, "edit_id", "left").select(by, "task_id", "edit_id", rank.alias("rank"), job.alias("job")), "rest")
    held = taken.groupBy(by).agg(F.count(F.lit(1)).alias("held"))
    fresh = rest.join(taken.select(by, "task_id"), [by, "task_id"], "left_anti").groupBy(by, "task_id").agg(F.min(F.struct("rank", "job")).alias("first"))
    fresh = fresh.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("first.rank"))).where(F.col("nth") <= limit)
    fresh = fresh.join(held, by, "left").withColumn("held", F.coalesce("held", F.lit(0))).where(F.col("held") + F.col("nth") <= limit)
    fresh = staged(fresh.select(by, "task_id", (F.col("held") + F.col("nth") - 1).cast("int").alias("place"), "first.job", "first.rank"), "picked")
    chosen = taken.unionByName(fresh.drop("rank"))
    # a full list ends with the job that filled it; one that isn't goes through all jobs, one full from the start through none
    ends = chosen.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(fresh.groupBy(by).agg(F.max("rank").alias("end")), by, "left")
    later = rest.join(ends, by).where((F.col("n") < limit) | (F.col("rank") <= F.col("end")))
    none = F.lit(None).cast(rest.schema["rank"].dataType)
    said = covering.select(by, "task_id", "edit_id", F.struct(F.lit(0).alias("step"), "turn", none.alias("rank")).alias("o")).unionByName(
        later.select(by, "task_id", "edit_id", F.struct(F.lit(1).alias("step"), F.lit(0).cast(edits.schema["ord"].dataType).alias("turn"), "rank").alias("o"))
    )
    origins = said.groupBy(by, "task_id", "edit_id").agg(F.min("o").alias("o")).groupBy(by, "task_id").agg(F.sort_array(F.collect_list(F.struct("o", "edit_id"))).alias("e"))
    met = chosen.join(origins, [by, "task_id"])
    return met.select(by, "place", "task_id", "job.*", F.transform("e", lambda x: x["edit_id"]).alias("origin_edit_ids"))
