"""Queries over cards, edits and their lifecycle. Documents stand for edits and cards, labels for outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import parsing
from tracequarry.operators import audit, cards, config, evaluate, ledger, markdown, sampling, state
from tracequarry.plans.base import Plans, table
from tracequarry.plans.ledgers import CARDS_SQL, edits
from tracequarry.plans.ledgers import cards as pool
from tracequarry.plans.records import pick

P = Plans()


def text_of(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


@P.query("""
SELECT doc_id AS ord, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS target, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 50) || ',s' || (doc_id % 7) END AS evidence_ids, source AS source_type, n_chars AS support_count FROM documents""")
def edit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ord")
    rows = edits(spark, sf_dir).withColumns(
        {"target": F.when(n % 4 == 0, "").otherwise(F.col("target")), "evidence_ids": F.when(n % 3 > 0, F.col("evidence_ids")).otherwise(F.array().cast("array<string>"))}
    )
    return cards.edit_payload(rows).select("ord", "target", F.array_join("evidence_ids", ",").alias("evidence_ids"), "source_type", "support_count")


@P.query("SELECT printf('W%06d', doc_id) AS edit_id, 'provisional' AS status, 3 AS introduced_epoch, doc_id AS introduced_order, 0 AS zeros FROM documents")
def new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cards.new_records(edits(spark, sf_dir), 3, "ord")
    zeros = F.col("support_events") + F.col("non_improvement_streak") + F.col("reflection_attempts") + F.col("comparison_count")
    return made.select("edit_id", "status", "introduced_epoch", "introduced_order", zeros.alias("zeros"))


@P.query("""
WITH l AS (SELECT doc_id AS task_id, arg_max(toxic = 0, toxic * 10 + quality) AS success, CAST(arg_max(quality, toxic * 10 + quality) AS DOUBLE) AS score FROM labels GROUP BY 1)
SELECT d.doc_id AS task_id, lang, success, score FROM documents d LEFT JOIN l ON l.task_id = d.doc_id""")
def records_with_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("task_id"), (F.col("toxic") == 0).alias("success"), F.col("quality").cast("double").alias("score"), (F.col("toxic") * 10 + F.col("quality")).alias("ord")
    )
    return cards.with_outcomes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), "lang"), results)


@P.query("SELECT doc_id, doc_id % 4 < 2 AS kept FROM documents")
def judged_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", pick(F.col("doc_id"), "keep", "KEEP", "drop", None).alias("decision"))
    kept, gone = cards.judged(rows)
    return kept.select("doc_id", F.lit(True).alias("kept")).unionByName(gone.select("doc_id", F.lit(False).alias("kept")))


@P.query("""
SELECT e.doc_id AS evidence_id, e.s AS start, string_agg(turn || role, ',' ORDER BY turn) AS segment
FROM (SELECT doc_id, doc_id % 97 AS conv, doc_id % 3 AS s FROM documents) e LEFT JOIN conversations c ON c.conv_id = e.conv AND c.turn BETWEEN e.s AND e.s + 2 GROUP BY 1, 2""")
def materialised_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges with their steps; those without any have none."""
    n = F.col("doc_id")
    drafts = table(spark, sf_dir, "documents").select(n.alias("evidence_id"), F.lit(0).alias("nth"), (n % 97).alias("task_id"), (n % 3).alias("start"), (n % 3 + 2).alias("end"))
    steps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("step"), F.col("role").alias("action"), F.col("text").alias("observation"))
    good, bad = cards.materialised(drafts, steps)
    said = F.array_join(F.transform("before_segment", lambda s: F.concat(s["step"].cast("string"), s["action"])), ",")
    return good.select("evidence_id", "start", said.alias("segment")).unionByName(bad.select("evidence_id", "start", F.lit(None).cast("string").alias("segment")))


@P.query(CARDS_SQL + """, w AS (SELECT CAST(evidence_id AS VARCHAR) AS id FROM c WHERE archived)
SELECT printf('W%06d', doc_id) AS edit_id FROM documents WHERE CAST(doc_id % 50 AS VARCHAR) IN (SELECT id FROM w) OR 's' || (doc_id % 7) IN (SELECT id FROM w)""")
def linked_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = pool(spark, sf_dir).where("archived").select(F.col("evidence_id").cast("string").alias("evidence_id"))
    return cards.linked(edits(spark, sf_dir), window).select("edit_id")


@P.query("""
WITH o AS (SELECT CAST(doc_id % 50 AS VARCHAR) AS e, min(doc_id) AS x FROM documents GROUP BY 1),
e AS (SELECT doc_id, CAST(doc_id % 50 AS VARCHAR) AS e, 0 AS p FROM documents UNION ALL SELECT doc_id, CAST(doc_id % 13 AS VARCHAR), 1 FROM documents),
v AS (SELECT e.doc_id, e.p, 0 AS q, 'O' || o.x AS v FROM e JOIN o ON o.e = e.e UNION ALL SELECT e.doc_id, e.p, 1, 'P' || (o.x % 5) FROM e JOIN o ON o.e = e.e),
f AS (SELECT doc_id, v, min(p * 2 + q) AS spot FROM v GROUP BY 1, 2)
SELECT printf('W%06d', doc_id) AS edit_id, string_agg(v, ',' ORDER BY spot) AS origins FROM f GROUP BY doc_id""")
def origin_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    known = docs.groupBy((n % 50).cast("string").alias("evidence_id")).agg(F.min("doc_id").alias("x"))
    known = known.select("evidence_id", F.array(F.concat(F.lit("O"), text_of("x")), F.lit(""), F.concat(F.lit("P"), text_of(F.col("x") % 5))).alias("origin_edit_ids"))
    cited = docs.select(F.format_string("W%06d", "doc_id").alias("edit_id"), F.array((n % 50).cast("string"), (n % 13).cast("string")).alias("evidence_ids"))
    return cards.origin_edits(cited, known).select("edit_id", F.array_join("origin_edit_ids", ",").alias("origins"))


@P.query("""
SELECT doc_id, sha256(rtrim(text) || chr(10) || chr(10) || 'Rule Y' || doc_id || chr(10)) AS sha, 'a,b' AS applied, 'c:target_not_found,d:unknown_op' AS failed FROM documents""")
def folded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document takes an appended rule and a change of it; two more edits fail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.col("doc_id").cast("string")

    def edit(at: int, name: str, op: str, target: Column, content: Column) -> Column:
        return F.struct(F.lit(at).alias("ord"), F.lit(name).alias("edit_id"), F.lit(op).alias("op"), target.alias("target"), content.alias("content"))

    none = F.lit(None).cast("string")
    todo = F.array(
        edit(0, "a", "Append", none, F.concat(F.lit(" Rule X"), n)), edit(1, "b", "replace", F.concat(F.lit("Rule X"), n), F.concat(F.lit("Rule Y"), n)),
        edit(2, "c", "delete", F.lit("<no such text>"), none), edit(3, "d", "rewrite", none, F.lit("x")),
    )
    made = markdown.fold_edits(docs, docs.select("doc_id", F.explode(todo).alias("e")).select("doc_id", "e.*"))
    return made.select("doc_id", F.sha2("text", 256).alias("sha"), F.array_join("applied", ",").alias("applied"), F.array_join("failed", ",").alias("failed"))


@P.query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256(rtrim(text) || chr(10) || chr(10) || 'x' || chr(10)) END AS sha FROM documents""")
def all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document has an edit that fails, and stays as it was."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edit = docs.select("doc_id", F.lit(0).alias("ord"), F.lit("a").alias("edit_id"), F.lit("append").alias("op"), F.lit("").alias("target"), F.lit("x").alias("content"))
    bad = edit.where("doc_id % 2 = 0").withColumns({"ord": F.lit(1), "op": F.lit("replace"), "target": F.lit("<no such text>")})
    return markdown.fold_edits(docs, edit.unionByName(bad), whole=True).select("doc_id", F.sha2("text", 256).alias("sha"))


@P.query("""
WITH r AS (SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS bundle, CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failure' END AS kind, o_orderdate FROM orders)
SELECT o_orderkey, bundle, kind || ':' || ((row_number() OVER (PARTITION BY bundle, kind ORDER BY o_orderdate, o_orderkey) - 1) // 4) AS minibatch FROM r""")
def minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("bundle"), "o_orderstatus", "o_orderdate")
    return cards.minibatches(rows, F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "bundle", "minibatch")


@P.query("SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 25")
def within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first edits of a budget: the limit is the operator."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.struct("n_chars", "doc_id").alias("at"))
    return cards.within_budget(rows, "at", 25).select("doc_id")


@P.query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 5)")
def recent_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five: the limit is the operator."""
    return ledger.recent(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id")


@P.query("SELECT o_orderkey FROM orders UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30)")
def limited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No limit keeps all rows, a limit the first ones."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.limited(rows, ["o_orderkey"], 0).select("o_orderkey").unionByName(sampling.limited(rows, ["o_totalprice", "o_orderkey"], 30).select("o_orderkey"))


@P.query(CARDS_SQL + "SELECT evidence_id, archived OR evidence_id % 5 = 0 AS archived, CASE WHEN archived THEN 'low' WHEN evidence_id % 5 = 0 THEN 'covered' END AS archive_reason FROM c")
def archived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pool(spark, sf_dir)
    return ledger.archive(rows, rows.where("evidence_id % 5 = 0"), "covered").select("evidence_id", "archived", "archive_reason")


@P.query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'stale' END, 'active') AS l2_status, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS attempts, 0 AS rejects, 1 AS support_count FROM documents")
def runtime_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 == 0, "stale").alias("l2_status"), F.when(n % 2 == 0, n).alias("attempts"))
    return state.with_defaults(rows).select("doc_id", "l2_status", "attempts", "rejects", "support_count")


@P.query("""
SELECT c.c_custkey AS task_id, s.o_orderkey AS stored FROM customer c JOIN orders s ON s.o_custkey = c.c_custkey
WHERE (s.o_orderkey % 3 = 0 OR s.o_orderpriority = '1-URGENT') AND (c.c_custkey % 2 = 0 OR s.o_orderkey % 5 = c.c_custkey % 5)""")
def checkpoint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third checkpoint has no file, every second task no bundle: what is missing contradicts nothing."""
    n, k = F.col("c_custkey"), F.col("o_orderkey")
    tasks = table(spark, sf_dir, "customer").select(n.alias("task_id"), F.lit("1-URGENT").alias("gamefile"), F.when(n % 2 > 0, n % 5).alias("bundle"))
    stored = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("gamefile"), (k % 5).alias("bundle"), k.alias("stored"))
    return state.matching_checkpoints(tasks, stored).select("task_id", F.col("checkpoint_stored").alias("stored"))


@P.query("""
SELECT o_orderstatus AS mode, count(*) AS tasks, round(avg(o_totalprice), 4) AS avg_score, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
  (SELECT CAST(sum(user_id) AS BIGINT) FROM events WHERE event_id % 2 = 0) AS accepted_edits, (SELECT CAST(sum(event_id) AS BIGINT) FROM events) AS committed_edits FROM orders GROUP BY 1""")
def mode_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("accepted_count"), F.col("event_id").alias("committed_count")).alias("l2"))
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "mode")
    made = evaluate.mode_sums(rows, logs, F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    return made.withColumns({"avg_score": F.round("avg_score", 4), "success_rate": F.round("success_rate", 6)})


@P.query("""
WITH r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'g' || (o_custkey % 40) ELSE 'f' || o_custkey END AS fam, o_orderstatus <> 'P' AS good FROM orders), s AS (SELECT fam, count(*) AS n, sum(CAST(good AS INTEGER)) AS g FROM r GROUP BY 1)
SELECT count(*) AS scenarios, round(100 * avg(CASE WHEN n = 3 AND g = 3 THEN 1.0 ELSE 0.0 END), 6) AS scenario_completion, round(100.0 * sum(g) / sum(n), 6) AS task_completion FROM s""")
def scenario_completion_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows name their family, the others have it in their id; a foreign row would leave no result."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        F.lit("AppWorld").alias("dataset"), F.concat(F.lit("f"), text_of(cust), F.lit("_"), text_of(key)).alias("task_id"),
        F.when(key % 2 == 0, F.concat(F.lit("g"), text_of(cust % 40))).otherwise("").alias("task_family"), (F.col("o_orderstatus") != "P").alias("good"),
    )
    whole = evaluate.scenario_completion_of(rows, "dataset", F.col("good"))
    foreign = evaluate.scenario_completion_of(rows.unionByName(rows.limit(1).withColumn("dataset", F.lit("other"))), "dataset", F.col("good"))
    return whole.unionByName(foreign).withColumns({c: F.round(c, 6) for c in ("scenario_completion", "task_completion")})


@P.query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'none') AS mode, 'eval' AS split FROM orders")
def enriched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("mode"))
    return evaluate.enrich(rows, mode=F.lit("none"), split=F.lit("eval"))


@P.query("SELECT c_mktsegment, CASE WHEN count(DISTINCT c_nationkey % 2) = 1 THEN max(c_nationkey % 2) END AS a, 'one' AS b FROM customer GROUP BY 1")
def single_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several values give null, one itself."""
    rows = table(spark, sf_dir, "customer")
    several = audit.single_value(rows, "c_mktsegment").select(F.col("value").alias("none"))
    one = audit.single_value(rows.withColumn("b", F.lit("one")), "b").select(F.col("value").alias("b"))
    each = rows.groupBy("c_mktsegment").agg(F.when(F.count_distinct(F.col("c_nationkey") % 2) == 1, F.max(F.col("c_nationkey") % 2)).alias("a"))
    return each.join(F.broadcast(one)).join(F.broadcast(several.where("none is null").drop("none")))  # one row each


@P.query("""
WITH t(i, v) AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/path/to/' || p_brand WHEN 1 THEN 'x/' || p_name WHEN 2 THEN 'replace-me' ELSE 'a/your/' || p_size END FROM part)
SELECT i AS p_partkey, i % 4 <> 1 AS placeholder FROM t""")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = pick(F.col("p_partkey"), F.concat(F.lit("/path/to/"), "p_brand"), F.concat(F.lit("x/"), "p_name"), "replace-me", F.concat(F.lit("a/your/"), text_of("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", config.is_placeholder(value).alias("placeholder"))


@P.query("""
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return sampling.looked_up(table(spark, sf_dir, "documents").select("doc_id"), items, "doc_id")


JUDGE_SQL = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'good' WHEN 2 THEN 'bad' WHEN 3 THEN 'bad' WHEN 4 THEN 'unparsed' ELSE 'good' END AS verdict FROM events"


@P.query(JUDGE_SQL)
def edit_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that go with what they say of a failure, some that don't, and no JSON."""
    raw = pick(
        F.col("event_id"), '{"decision": "accept", "replay_failure_type": "rule_ignored", "reason": "x"}', '```json\n{"decision": "Reflect", "replay_failure_type": "rule_wrong"}\n```',
        '{"decision": "accept", "replay_failure_type": "rule_missing"}', '{"decision": "reflect", "replay_failure_type": null}', "no answer", 'so: {"decision": "reject", "replay_failure_type": "null"}',
    )
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    parsed, unparsed = parsing.parse_contract(rows, F.col("raw"), "edit_judge")
    good, bad = parsing.accepted(parsed, "edit_judge")
    parts = [d.select("event_id", F.lit(v).alias("verdict")) for d, v in ((good, "good"), (bad, "bad"), (unparsed, "unparsed"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@P.query("""
SELECT event_id, 0 AS ord, 'append' AS op, 'rule ' || user_id AS content FROM events
UNION ALL SELECT event_id, 2, 'replace', 'b' FROM events WHERE event_id % 2 = 0""")
def patch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits out of a merger's answer; unknown ops and edits that say nothing go."""
    n = F.col("event_id")
    raw = F.concat(
        F.lit('{"reasoning": "r", "merged_edits": [{"op": " Append ", "content": "rule '), text_of("user_id"), F.lit('"}, {"op": "rewrite", "content": "x"}, {"op": "replace", "target": "'),
        F.when(n % 2 == 0, "a").otherwise(" "), F.lit('", "content": "b"}, null]}'),
    )
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    parsed, _ = parsing.parse_contract(rows, F.col("raw"), "epoch_merger")
    return parsing.normal_edits(parsing.items_of(parsed, "event_id", "merged_edits")).select("event_id", "ord", "op", "content")
