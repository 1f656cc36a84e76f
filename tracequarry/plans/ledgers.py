"""Edit and evidence queries. Documents stand for edits and cards, labels for outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import jobs, ledger
from tracequarry.plans.base import Plans, table

P = Plans()


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as edits: same text, same edit; each cites two cards."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.format_string("W%06d", "doc_id").alias("edit_id"),
        F.lit("Append").alias("op"),
        F.col("lang").alias("target"),
        F.col("text").alias("content"),
        F.array((F.col("doc_id") % 50).cast("string"), F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"))).alias("evidence_ids"),
        F.col("source").alias("source_type"),
        F.col("n_chars").alias("support_count"),
        (F.col("doc_id") % 4).alias("merge_level"),
    )


EDITS_SQL = """WITH e AS (SELECT doc_id AS ord, printf('W%06d', doc_id) AS edit_id, lang AS target, text AS content, source, n_chars, doc_id % 4 AS lvl, trim(text) AS k FROM documents),
v AS (
  SELECT ord, target, k, 'evidence_ids' AS list, 0 AS after, 0 AS spot, CAST(ord % 50 AS VARCHAR) AS x FROM e UNION ALL SELECT ord, target, k, 'evidence_ids', 0, 1, 's' || (ord % 7) FROM e
  UNION ALL SELECT ord, target, k, 'failure_types', 0, 0, source FROM e UNION ALL SELECT ord, target, k, 'failure_types', 0, 1, 'f' || (ord % 3) FROM e
  UNION ALL SELECT ord, target, k, 'patterns', 0, 0, x FROM (SELECT *, regexp_replace(left(content, 12), '^\\s+|\\s+$', '', 'g') AS x FROM e) WHERE x <> ''
  UNION ALL SELECT ord, target, k, 'source_edit_ids', 0, 0, 'S' || (ord % 11) FROM e
  UNION ALL SELECT ord, target, k, 'source_edit_ids', 1, 0, 'C' || ord FROM e WHERE ord % 2 = 0
), n AS (SELECT target, k, count(*) AS copies FROM e GROUP BY 1, 2),
f AS (SELECT target, k, list, x, min({'after': after, 'ord': ord, 'spot': spot}) AS o FROM v GROUP BY 1, 2, 3, 4),
i AS (SELECT f.target, f.k, list, string_agg(x, ',' ORDER BY o) AS said FROM f JOIN n ON n.target = f.target AND n.k = f.k WHERE copies > 1 OR o.after = 0 GROUP BY 1, 2, 3)
"""


@P.query(EDITS_SQL + """
SELECT min(e.ord) AS ord, arg_min(edit_id, e.ord) AS edit_id, any_value(a.said) AS evidence_ids, any_value(b.said) AS source_edit_ids, any_value(c.said) AS failure_types, coalesce(any_value(d.said), '') AS patterns,
  CASE WHEN count(DISTINCT source) > 1 THEN 'mixed' ELSE min(source) END AS source_type, max(n_chars) AS support_count, max(lvl) AS merge_level,
  CASE WHEN count(*) > 1 THEN string_agg(edit_id, ',' ORDER BY e.ord) END AS merged_from
FROM e JOIN i a ON e.target = a.target AND e.k = a.k AND a.list = 'evidence_ids' JOIN i b ON e.target = b.target AND e.k = b.k AND b.list = 'source_edit_ids'
  JOIN i c ON e.target = c.target AND e.k = c.k AND c.list = 'failure_types' LEFT JOIN i d ON e.target = d.target AND e.k = d.k AND d.list = 'patterns' GROUP BY e.target, e.k""")
def coalesce_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal documents as one edit, with all four lists that are united, and candidates that join the sources."""
    n = F.col("ord").cast("string")
    rows = edits(spark, sf_dir).withColumns(
        {
            "source_edit_ids": F.array(F.concat(F.lit("S"), (F.col("ord") % 11).cast("string"))),
            "failure_types": F.array("source_type", F.concat(F.lit("f"), (F.col("ord") % 3).cast("string"))),
            "patterns": F.array(F.substring("content", 1, 12)),
            "candidate_id": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("C"), n)),
        }
    )
    made = ledger.coalesce_edits(rows)
    lists = ("evidence_ids", "source_edit_ids", "failure_types", "patterns", "merged_from")
    return made.select("ord", "edit_id", *(F.array_join(c, ",").alias(c) for c in lists), "source_type", "support_count", "merge_level")


@P.query("""
WITH r AS (SELECT doc_id AS ord, printf('W%06d', doc_id) AS edit_id, lang, trim(text) AS k, CASE doc_id % 5 WHEN 0 THEN 'provisional' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'needs_correction' WHEN 3 THEN 'removed' ELSE 'superseded' END AS status,
  doc_id % 3 AS sup, doc_id % 2 AS cmp, doc_id % 6 AS streak FROM documents),
g AS (SELECT min(ord) AS ord, arg_min(edit_id, ord) AS edit_id, arg_min(status, ord) AS st, max(ord) FILTER (status IN ('unresolved', 'needs_correction')) AS lo,
  arg_max(status, ord) FILTER (status IN ('unresolved', 'needs_correction')) AS ls, CAST(sum(sup) AS BIGINT) AS support_events, CAST(sum(cmp) AS BIGINT) AS comparison_count, max(streak) AS non_improvement_streak
  FROM r GROUP BY lang, k)
SELECT ord, edit_id, CASE WHEN lo > ord THEN ls ELSE st END AS status, support_events, comparison_count, non_improvement_streak FROM g""")
def ledger_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*(F.lit(s) for s in ("provisional", "unresolved", "needs_correction", "removed", "superseded")))
    rows = edits(spark, sf_dir).withColumns(
        {
            "status": F.get(states, (F.col("ord") % 5).cast("int")),
            "support_events": F.col("ord") % 3,
            "comparison_count": F.col("ord") % 2,
            "non_improvement_streak": F.col("ord") % 6,
            "reflection_attempts": F.lit(0),
        }
    )
    return ledger.coalesce_ledger(rows).select("ord", "edit_id", "status", "support_events", "comparison_count", "non_improvement_streak")


@P.query("""
WITH v AS (SELECT doc_id AS o, 0 AS p, CAST(doc_id % 50 AS VARCHAR) AS id FROM documents WHERE doc_id % 5 <> 3 UNION ALL SELECT doc_id, 1, 's' || (doc_id % 7) FROM documents WHERE doc_id % 5 <> 3),
f AS (SELECT id, o, p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, p) AS rn FROM v) WHERE rn = 1)
SELECT id, o AS doc, CAST(p AS INTEGER) AS place FROM f""")
def ordered_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("ord") % 5 == 3, "removed").otherwise("provisional")
    rows = ledger.live(edits(spark, sf_dir).withColumn("status", status))
    return ledger.ids_in_order(rows, "evidence_ids", ["ord"]).select("id", F.col("first.o.ord").alias("doc"), F.col("first.at").alias("place"))


@P.query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'E9' || doc_id ELSE printf('E%06d', 99 + sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END) OVER (ORDER BY doc_id)) END AS evidence_id FROM documents""")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("E9"), F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", own.alias("evidence_id"))
    return ledger.assign_ids(rows, "evidence_id", "E", 100, "doc_id")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards; those labelled of low quality are archived."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").join(marks, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("evidence_id"),
        F.col("doc_id").alias("ord"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("archived"),
        F.when(F.col("quality").isNull(), "active").otherwise("judged").alias("l2_status"),
        F.when(F.col("quality") == 0, "low").alias("archive_reason"),
        F.lit(None).cast("string").alias("consume_reason"),
        F.lit(None).cast("string").alias("defer_reason"),
        (F.col("doc_id") % 3).cast("int").alias("attempts"),
        (F.col("doc_id") % 2).cast("int").alias("rejects"),
    )


CARDS_SQL = """WITH m AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1), c AS (
  SELECT d.doc_id AS evidence_id, coalesce(q = 0, false) AS archived, CASE WHEN q IS NULL THEN 'active' ELSE 'judged' END AS l2_status, d.doc_id % 3 AS attempts, d.doc_id % 2 AS rejects
  FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id) """


@P.query(CARDS_SQL + "SELECT CASE WHEN archived THEN 'archived' ELSE l2_status END AS status, count(*) AS n FROM c GROUP BY 1")
def pool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pool_counts(cards(spark, sf_dir))


@P.query(CARDS_SQL + """
SELECT evidence_id, archived AND evidence_id % 4 <> 0 AS archived, CASE WHEN evidence_id % 4 = 0 THEN 'active' ELSE l2_status END AS l2_status,
  CASE WHEN archived AND evidence_id % 4 <> 0 THEN 'low' END AS archive_reason, CASE WHEN evidence_id % 4 = 0 THEN 'origin_edit_removed' END AS defer_reason FROM c""")
def ledger_reactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cards(spark, sf_dir)
    made = ledger.reactivate(rows, rows.where("evidence_id % 4 = 0").select("evidence_id"))
    return made.select("evidence_id", "archived", "l2_status", "archive_reason", "defer_reason")


@P.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def archive_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("quality = 0")
    return ledger.without(table(spark, sf_dir, "documents").select("doc_id"), gone, "doc_id")


@P.query("SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 0")
def uncited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    cited = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("id"))
    return ledger.without(chosen.distinct(), cited, "id")


@P.query(CARDS_SQL + "SELECT evidence_id FROM c WHERE NOT archived ORDER BY attempts, evidence_id LIMIT 20")
def evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.select_window(cards(spark, sf_dir), 20).select("evidence_id")


@P.query(CARDS_SQL + """
SELECT evidence_id, attempts + CASE WHEN evidence_id % 6 = 0 THEN 1 ELSE 0 END AS attempts, rejects + CASE WHEN evidence_id % 9 = 0 THEN 1 ELSE 0 END AS rejects,
  CASE WHEN evidence_id % 9 = 0 AND rejects + 1 >= 2 THEN 'stale' ELSE l2_status END AS l2_status FROM c""")
def evidence_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cards(spark, sf_dir)
    made = ledger.mark_attempts(rows, rows.where("evidence_id % 6 = 0"), rows.where("evidence_id % 9 = 0"))
    return made.select("evidence_id", F.col("attempts").cast("long").alias("attempts"), F.col("rejects").cast("long").alias("rejects"), "l2_status")


JOBS_SQL = """
WITH r AS (SELECT o_custkey, 'T' || (o_orderkey % 200) AS task_id, o_orderkey % 5 AS start, o_orderkey % 5 + 3 AS "end", count(*) OVER (PARTITION BY o_custkey) AS support,
  CASE WHEN (o_orderkey % 200) % 2 = 0 THEN 'even' ELSE '' END AS task_family FROM orders)
SELECT printf('M%06d', c_custkey) AS edit_id, task_id, task_family, CAST(c_custkey AS VARCHAR) AS evidence_id, start, "end", support AS support_count,
  CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY task_family, task_id, start) AS INTEGER) AS rn FROM customer JOIN r ON o_custkey = c_custkey"""


def edits_and_cards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as edits, each citing the card that its orders make."""
    task = F.concat(F.lit("T"), (F.col("o_orderkey") % 200).cast("string"))
    span = F.struct(task.alias("task_id"), (F.col("o_orderkey") % 5).alias("start"), (F.col("o_orderkey") % 5 + 3).alias("end"))
    known = F.when(F.col("o_orderkey") % 2 == 0, F.struct(task.alias("task_id"), F.lit("even").alias("task_family")))
    evidence = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("evidence_id")).agg(
        F.count(F.lit(1)).alias("support_count"), F.array_sort(F.collect_list(span)).alias("trigger_ranges"), F.collect_list(known).alias("supporting_tasks")
    )
    made = table(spark, sf_dir, "customer").select(
        F.format_string("M%06d", "c_custkey").alias("edit_id"), F.array(F.col("c_custkey").cast("string")).alias("evidence_ids")
    )
    return made, evidence


@P.query(JOBS_SQL)
def comparison_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay jobs of all customers' edits, ranked for each edit."""
    return ledger.comparison_jobs(*edits_and_cards(spark, sf_dir))


@P.query(JOBS_SQL)
def replay_jobs_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same jobs by a call of SQL."""
    jobs.register(spark)
    view = f"spans_{uuid.uuid4().hex}"
    ledger.job_spans(*edits_and_cards(spark, sf_dir)).createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM replay_jobs(TABLE({view}))")


@P.query("WITH j AS (" + JOBS_SQL + """),
own AS (SELECT c_nationkey AS nation, c_custkey AS turn, j.* FROM j JOIN customer ON edit_id = printf('M%06d', c_custkey)),
asked AS (SELECT nation, task_id, min(turn) AS turn FROM own WHERE rn = 1 GROUP BY 1, 2),
taken AS (SELECT nation, task_id, turn, row_number() OVER (PARTITION BY nation ORDER BY turn) AS spot FROM asked QUALIFY spot <= 20),
covered AS (SELECT DISTINCT edit_id FROM own JOIN taken USING (nation, task_id) WHERE rn = 1),
rest AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY edit_id IN (SELECT edit_id FROM covered), support_count DESC, task_family, task_id, edit_id, sha256('7:' || edit_id || ':' || task_id || ':' || rn)) AS pl FROM own),
fresh AS (SELECT nation, task_id, min(pl) AS pl FROM rest ANTI JOIN taken USING (nation, task_id) GROUP BY 1, 2),
added AS (SELECT f.*, held + row_number() OVER (PARTITION BY nation ORDER BY pl) AS spot FROM fresh f JOIN (SELECT nation, count(*) AS held FROM taken GROUP BY 1) h USING (nation) QUALIFY spot <= 20),
chosen AS (
  SELECT nation, task_id, spot, o.edit_id, o.start, o.support_count FROM taken JOIN own o USING (nation, task_id, turn) WHERE o.rn = 1
  UNION ALL SELECT nation, task_id, spot, r.edit_id, r.start, r.support_count FROM added JOIN rest r USING (nation, task_id, pl)),
ends AS (SELECT c.nation, CASE WHEN count(*) < 20 THEN 1000000000 ELSE coalesce((SELECT max(pl) FROM added a WHERE a.nation = c.nation), 0) END AS last FROM chosen c GROUP BY 1),
said AS (
  SELECT nation, task_id, o.edit_id, CAST(o.turn AS BIGINT) AS o FROM taken JOIN own o USING (nation, task_id) WHERE o.rn = 1
  UNION ALL SELECT r.nation, r.task_id, r.edit_id, 1000000000 + r.pl FROM rest r JOIN ends USING (nation) WHERE r.pl <= last),
origins AS (SELECT nation, task_id, string_agg(edit_id, ',' ORDER BY o) AS origin_edit_ids FROM (SELECT nation, task_id, edit_id, min(o) AS o FROM said GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT nation, CAST(spot - 1 AS INTEGER) AS place, task_id, edit_id, start, support_count, origin_edit_ids FROM chosen JOIN origins USING (nation, task_id)""")
def picked_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 tasks that the edits of each nation's customers compare; the limit is the operator."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.format_string("M%06d", "c_custkey").alias("edit_id"), F.col("c_custkey").alias("ord"))
    made = ledger.picked_tasks(comparison_jobs(spark, sf_dir), rows, "nation", 7)
    return made.select("nation", "place", "task_id", "edit_id", "start", "support_count", F.array_join("origin_edit_ids", ",").alias("origin_edit_ids"))
