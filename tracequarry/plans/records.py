"""Queries over texts of records: actions, JSON in prose, histories, references, budgets, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions import parsing, render, resolve, scalar
from tracequarry.functions import text as X
from tracequarry.operators import trajectory
from tracequarry.plans.base import Plans, table
from tracequarry.plans.steps import conversations_as_steps
from tracequarry.sources import manifests
from tracequarry.sources import records as files

P = Plans()


def pick(number: Column, *values: Column | str | None) -> Column:
    """One of several values, by a number."""
    return F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (number % len(values)).cast("int"))


@P.query("""
WITH p AS (SELECT *, ['look', 'take ' || p_name, 'go to ' || p_brand, ' open ' || p_type || ' '] AS known,
  CASE p_partkey % 6 WHEN 0 THEN ' go to ' || p_brand || ' ' WHEN 1 THEN 'GO   to ' || upper(p_brand) WHEN 2 THEN 'I will take ' || p_name || ' now'
    WHEN 3 THEN 'look and take ' || p_name WHEN 4 THEN 'jump' ELSE 'open ' || p_type END AS said FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'go to ' || p_brand WHEN 1 THEN 'go to ' || p_brand WHEN 2 THEN 'take ' || p_name ELSE trim(said) END AS action FROM p""")
def matched_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    known = F.array(F.lit("look"), F.concat(F.lit("take "), name), F.concat(F.lit("go to "), brand), F.concat(F.lit(" open "), kind, F.lit(" ")))
    said = pick(
        F.col("p_partkey"), F.concat(F.lit(" go to "), brand, F.lit(" ")), F.concat(F.lit("GO   to "), F.upper(brand)), F.concat(F.lit("I will take "), name, F.lit(" now")),
        F.concat(F.lit("look and take "), name), "jump", F.concat(F.lit("open "), kind),
    )
    return table(spark, sf_dir, "part").select("p_partkey", X.match_action(said, known).alias("action"))


@P.query(r"""
SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS a, CASE WHEN t LIKE '%.' THEN left(t, length(t) - 1) ELSE t END AS action
FROM (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations)""")
def normal_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(X.squeeze("text")).alias("a"), X.normal_action("text").alias("action"))


PROSE_SQL = """
SELECT event_id, CASE event_id % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN '{"a": [1, {"b": "x"}]}' ELSE props END AS found FROM events"""


@P.query(PROSE_SQL)
def json_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, after prose and broken braces, none, an array, and nested."""
    props = F.col("props")
    raw = pick(
        F.col("event_id"), F.concat(F.lit("```json\n"), props, F.lit("\n```")), F.concat(F.lit("so {not this} but "), props, F.lit(" and {more}")), props,
        "nothing { here", "[1, 2]", 'first {"a": [1, {"b": "x"}]} then {"c": 2}',
    )
    return table(spark, sf_dir, "events").select("event_id", parsing.column_of(parsing.first_object)(raw).alias("found"))


@P.query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'x = ' || user_id WHEN 1 THEN 'y = ' || user_id WHEN 2 THEN 'z = ' || user_id WHEN 3 THEN 'w = ' || user_id ELSE 'print(apis.api_docs.show_app_descriptions())' END AS code FROM events""")
def code_in_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("user_id").cast("string")
    raw = pick(
        F.col("event_id"), F.concat(F.lit("Do <action>\n```python\nx = "), n, F.lit("\n```\n</action>")), F.concat(F.lit("```py\ny = "), n), F.concat(F.lit('say {"code": "z = '), n, F.lit('"}')),
        F.concat(F.lit("w = "), n), "not code at all ((", "",
    )
    return table(spark, sf_dir, "events").select("event_id", parsing.column_of(parsing.code_of)(raw).alias("code"))


@P.query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN 'a' || event_type WHEN 2 THEN 'why ' || event_type WHEN 3 THEN 'plain ' || event_type END AS said,
  CASE event_id % 6 WHEN 4 THEN 'bad ' || event_type WHEN 5 THEN 'response without text' END AS error FROM events""")
def choice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    raw = pick(
        F.col("event_id"),
        F.concat(F.lit('{"choices": [{"message": {"content": "'), kind, F.lit('"}}]}')),
        F.concat(F.lit('{"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "'), kind, F.lit('"}]}}]}')),
        F.concat(F.lit('{"choices": [{"message": {"content": null, "reasoning_content": "why '), kind, F.lit('"}}]}')),
        F.concat(F.lit('{"choices": [{"text": "plain '), kind, F.lit('"}]}')),
        F.concat(F.lit('{"error": {"message": "bad '), kind, F.lit('"}}')),
        '{"choices": []}',
    )
    return table(spark, sf_dir, "events").select("event_id", parsing.choice_text(raw).alias("said"), parsing.response_error(raw).alias("error"))


@P.query("""
WITH t AS (SELECT conv_id, string_agg('Step ' || turn || ': observation=' || text || ' action=' || role, chr(10) ORDER BY turn) AS a,
  string_agg('[Observation ' || (turn + 1) || ': ''' || text || ''', Action ' || (turn + 1) || ': ''' || role || ''']', chr(10) ORDER BY turn) AS b FROM conversations GROUP BY 1)
SELECT conv_id, sha256(a) AS plain, sha256(b) AS bracketed FROM t""")
def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.col("trajectory")
    return conversations_as_steps(spark, sf_dir).select("conv_id", F.sha2(render.plain_history(steps), 256).alias("plain"), F.sha2(render.bracketed_history(steps), 256).alias("bracketed"))


@P.query(r"""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER w - 1 AS step, lag(o_totalprice) OVER w / 100 AS a, o_totalprice / 100 AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
f AS (SELECT *, regexp_replace(printf('%.4f', a), '\.?0+$', '') AS x, regexp_replace(printf('%.4f', b), '\.?0+$', '') AS y, regexp_replace(printf('%+.4f', b - a), '\.?0+$', '') AS d FROM s)
SELECT o_custkey, string_agg('Step ' || step || chr(10) || 'Observation: ' || o_orderpriority || chr(10) || 'Action: ' || o_orderstatus || chr(10) || 'Result: ' || o_orderkey || chr(10)
  || CASE WHEN a IS NULL THEN 'Score: unavailable' ELSE 'Score: ' || x || ' -> ' || y || ' (delta ' || d || ')' END, chr(10) || chr(10) ORDER BY step) AS history FROM f GROUP BY 1""")
def scored_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    after, before = F.col("o_totalprice") / 100, F.lag("o_totalprice").over(w) / 100
    step = F.struct(
        (F.row_number().over(w) - 1).alias("step"), F.col("o_orderpriority").alias("observation"), F.col("o_orderstatus").alias("action"), F.col("o_orderkey").cast("string").alias("next_observation"),
        before.alias("score_before"), after.alias("score_after"), (after - before).alias("score_delta"),
    )
    rows = table(spark, sf_dir, "orders").select("o_custkey", step.alias("s")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    return rows.select("o_custkey", render.scored_history(F.col("steps")).alias("history"))


@P.query("""
SELECT o_custkey, 'The following skill edits were committed during this epoch.' || chr(10) || chr(10) || string_agg(n || '. op: ' || o_orderstatus || chr(10) || 'target: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE o_orderpriority END
    || chr(10) || 'content:' || chr(10) || CASE WHEN o_orderkey % 5 = 0 THEN '(empty)' ELSE 'c' || o_orderkey END, chr(10) || chr(10) ORDER BY n) AS summary,
  string_agg(lower(o_orderstatus) || ':' || CASE WHEN o_orderkey % 5 > 0 THEN 'c' || o_orderkey WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END, '; ' ORDER BY n) AS short
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1""")
def edit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    edit = F.struct(
        key, F.col("o_orderstatus").alias("op"), F.when(key % 3 > 0, F.col("o_orderpriority")).otherwise("").alias("target"),
        F.when(key % 5 > 0, F.concat(F.lit("c"), key.cast("string"))).alias("content"),
    )
    rows = table(spark, sf_dir, "orders").select("o_custkey", edit.alias("e")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("e")).alias("edits"))
    return rows.select("o_custkey", render.update_summary(F.col("edits")).alias("summary"), render.short_edits(F.col("edits")).alias("short"))


@P.query("""
SELECT doc_id, sha256('## Previous Epoch''s Skill' || chr(10) || lang || chr(10) || chr(10) || '## Current Epoch''s Skill' || chr(10) || text || chr(10) || chr(10) || '## Previous Longitudinal Memory' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '(No previous longitudinal memory.)' ELSE source END || chr(10) || chr(10) || '## Skill Update Summary' || chr(10) || n_chars || chr(10) || chr(10) || '## Longitudinal Comparison' || chr(10)) AS sha FROM documents""")
def memory_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("source"), F.lit("\n")))
    text = render.memory_input(F.col("lang"), F.col("text"), memory, F.col("n_chars").cast("string"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("sha"))


@P.query("""
SELECT doc_id, sha256('=' || sha256(text) || chr(31) || '=' || lang || chr(31) || CASE WHEN doc_id % 2 = 0 THEN '~' ELSE '=' || source END || chr(31) || '=E' || doc_id || chr(31) || '=' || (doc_id % 5) || chr(31) || '=t' || chr(31) || '=') AS key FROM documents""")
def replay_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null and an empty text give different keys."""
    source = F.when(F.col("doc_id") % 2 > 0, F.col("source"))
    key = scalar.replay_key(F.col("text"), [F.col("lang"), source], F.concat(F.lit("E"), F.col("doc_id").cast("string")), F.col("doc_id") % 5, [F.lit("t"), F.lit("")])
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))


@P.query("""
SELECT CAST(conv_id AS VARCHAR) AS task_id, 'task_id,instruction,trajectory,task_family' AS fields, 'step,observation,action' AS step_fields,
  string_agg(turn || ':' || role || ':' || left(text, 40), '|' ORDER BY turn) FILTER (turn < 3) AS steps FROM conversations GROUP BY conv_id""")
def records_without_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations_as_steps(spark, sf_dir).withColumn("task_id", F.col("conv_id").cast("string"))
    made = trajectory.without_rewards(trajectory.normal_record(rows, limit=3, chars=40))
    inner = made.schema["trajectory"].dataType.elementType.fieldNames()
    steps = F.transform("trajectory", lambda s: F.concat_ws(":", s["step"].cast("string"), s["action"], s["observation"]))
    return made.select("task_id", F.lit(",".join(made.columns)).alias("fields"), F.lit(",".join(inner)).alias("step_fields"), F.array_join(steps, "|").alias("steps"))


@P.query("""
SELECT CAST(conv_id AS VARCHAR) AS task_id, CAST(sum(length(text)) FILTER (rn <= 24) AS DOUBLE) AS reward, CAST(sum(least(length(text), 1500)) FILTER (rn <= 24) AS BIGINT) AS seen, CAST(7.5 AS DOUBLE) AS observed_reward
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id""")
def legacy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations_as_steps(spark, sf_dir).withColumns({"task_id": F.col("conv_id").cast("string"), "final_reward": F.lit(7.5)})
    made = trajectory.legacy_record(rows)
    t = F.col("trajectory")
    return made.select(
        "task_id", F.aggregate(t, F.lit(0.0), lambda a, s: a + s["reward"]).alias("reward"),
        F.aggregate(t, F.lit(0).cast("long"), lambda a, s: a + F.char_length(s["observation"])).alias("seen"), F.col("observed_reward"),
    )


@P.query("SELECT conv_id, sha256(string_agg(turn || role || text, '|' ORDER BY turn)) AS sha FROM conversations GROUP BY 1")
def records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories written as JSON and read back with their type."""
    rows = conversations_as_steps(spark, sf_dir)
    kind = rows.schema["trajectory"].dataType
    back = files.deserialised(files.serialised(rows, "trajectory"), "trajectory", kind).select("conv_id", F.col("trajectory").alias("t"))
    said = F.transform("t", lambda s: F.concat(s["step"].cast("string"), s["action"], s["observation"]))
    return back.select("conv_id", F.sha2(F.array_join(said, "|"), 256).alias("sha"))


@P.query("""
WITH r AS (SELECT user_id, event_type, event_id, ts, event_id % 2 AS seg, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id, event_id % 2) AS total FROM events),
c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id, seg ORDER BY rn) = event_type THEN 0 ELSE 1 END AS new FROM r WHERE rn <= 12),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, seg ORDER BY rn) AS run FROM c),
k AS (SELECT user_id, seg, run, min(event_type) AS a, count(*) AS n, max(total) AS total FROM g GROUP BY 1, 2, 3),
s AS (SELECT user_id, seg, string_agg(a || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ' -> ' ORDER BY run) || CASE WHEN max(total) > 12 THEN ' -> [truncated]' ELSE '' END AS t FROM k GROUP BY 1, 2)
SELECT user_id, CASE WHEN count(*) > 1 THEN string_agg('segment ' || (seg + 1) || ': ' || t, chr(10) ORDER BY seg) ELSE min(t) END AS text FROM s GROUP BY 1""")
def segment_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments of a user's events: those with even and those with odd numbers."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    step = F.struct(F.col("at").alias("step"), F.col("event_type").alias("action"))
    parts = rows.groupBy("user_id", (F.col("event_id") % 2).alias("seg")).agg(F.collect_list(step).alias("steps"))
    whole = parts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seg", "steps"))).alias("parts"))
    return whole.select("user_id", trajectory.segment_runs(F.transform("parts", lambda p: p["steps"])).alias("text"))


BEFORE_AFTER_SQL = """WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Nothing happens.' WHEN 1 THEN 'You can''t go' WHEN 2 THEN 'same' WHEN 3 THEN 'Unknown action' WHEN 4 THEN 'same' WHEN 5 THEN 'I DON''T understand' ELSE 'new' END AS a,
  CASE event_id % 3 WHEN 0 THEN 'look' WHEN 1 THEN 'look around' ELSE 'go' END AS act FROM events)
"""


@P.query(BEFORE_AFTER_SQL + """
SELECT event_id, event_id % 7 IN (0, 1, 5) OR (a = 'same' AND act <> 'look') AS bad_a, event_id % 7 IN (0, 1, 3, 5) OR (a = 'same' AND act = 'go') AS bad_c,
  event_id % 5 = 0 OR event_id % 7 IN (1, 2) AS failed FROM e""")
def step_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    after = pick(n, "Nothing happens.", "You can't go", "same", "Unknown action", " same ", "I DON'T understand", "new")
    action, code = pick(n, "look", "look around", "go"), pick(n, " ", "x", "y", "z", "w")
    output = pick(n, "fine", "Execution FAILED. Traceback: x", "maximum number of executions", "ok", "", "done", "x")
    return table(spark, sf_dir, "events").select(
        "event_id", scalar.bad_step(F.lit("same"), after, action).alias("bad_a"), scalar.bad_step(F.lit("same"), after, action, scalar.FAILED_C, scalar.IDLE_C).alias("bad_c"),
        scalar.execution_failed(code, output).alias("failed"),
    )


@P.query("""
SELECT doc_id, doc_id % 4 = 1 AND length(trim(text)) > 0 AS inside FROM documents""")
def in_protected_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target inside the region, before it, in a document without one, and nowhere."""
    n = F.col("doc_id")
    target = F.concat(F.lit("<<"), n.cast("string"), F.lit(">>"))
    doc = pick(n, F.concat(target, X.with_region("text", "lang")), X.with_region("text", target), F.concat("text", target), X.with_region("text", "lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", doc.alias("doc"), target.alias("target"))
    return rows.select("doc_id", X.in_region(F.col("doc"), F.col("target")).alias("inside"))


@P.query(r"""
WITH p AS (SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_.\-]+', '_', 'g'), '._') AS a FROM pages)
SELECT page_id, coalesce(nullif(left(a, 80), ''), 'item') AS part, coalesce(nullif(left(a, 12), ''), 'item') AS short FROM p""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.safe_part("url").alias("part"), X.safe_part("url", 12).alias("short"))


@P.query(r"""
SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name || ' v' || p_size || '..' || (p_size % 3)), '[^a-z0-9.]+', '_', 'g'), '_.'), '\.{2,}', '.', 'g') AS slug FROM part""")
def model_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    name = F.concat(F.lit("models/"), F.col("p_name"), F.lit(" v"), size, F.lit(".."), (F.col("p_size") % 3).cast("string"), F.lit("/"))
    return table(spark, sf_dir, "part").select("p_partkey", X.model_slug(name, "model").alias("slug"))


@P.query("SELECT c_custkey, 'http://' || c_custkey || '|x' AS urls, 'attempt ' || (c_custkey % 9) || '/5' AS label, 'attempt ' || (c_custkey % 9) AS endless FROM customer")
def urls_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" http://"), F.col("c_custkey").cast("string"), F.lit(" , ,x,"))
    n = F.col("c_custkey") % 9
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(X.url_list(raw), "|").alias("urls"), X.attempt_label(n, 5).alias("label"), X.attempt_label(n, 0).alias("endless")
    )


@P.query("""
WITH e AS (SELECT o_orderkey, 4096 + o_orderkey % 1000 AS lim, 3000 + o_orderkey % 1300 AS used, 512 + o_orderkey % 700 AS budget, o_orderkey % 2 = 0 AS bounded FROM orders),
n AS (SELECT *, least(budget - 1, CASE WHEN bounded THEN budget // 2 ELSE budget END, lim - used - least(256, greatest(8, CAST(floor((lim - used) / 16) AS BIGINT)))) AS new FROM e)
SELECT o_orderkey, CASE WHEN new >= 1 AND o_orderkey % 5 > 0 THEN new END AS fits, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 < 5 AND greatest(128, budget // 2) < budget THEN greatest(128, budget // 2) END AS half FROM n""")
def retry_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    limit, used, budget = 4096 + key % 1000, 3000 + key % 1300, 512 + key % 700
    least = F.when(key % 2 == 0, F.lit("at least ")).otherwise("")
    said = F.concat(F.lit("This model's maximum context length is "), F.format_number(limit, 0), F.lit(" tokens, but the prompt contains "), least, used.cast("string"), F.lit(" input tokens"))
    status = F.when(key % 5 > 0, 400).otherwise(500)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", render.retry_budget(status, said, budget).cast("long").alias("fits"),
        render.halved_budget(status, F.lit("the Context Window is full"), budget, key % 7).cast("long").alias("half"),
    )


@P.query("""
SELECT c_custkey, ['none', 'static_markdown', 'evolving_markdown', 'unknown'][c_custkey % 4 + 1] AS source, CASE WHEN c_custkey % 3 = 0 THEN 'low' WHEN c_custkey % 3 = 1 THEN 'medium' END AS effort FROM customer""")
def sources_and_efforts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    mode, model, given = pick(n, "no_skill", "static", "evolve", "other"), pick(n, "gpt-5-mini", "GPT-5.1-Mini", "gpt-4"), pick(n, "low", "", None)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", render.document_source(mode, ("no_skill",), "static", "evolve").alias("source"), render.reasoning_effort(model, given).alias("effort")
    )


@P.query("""
SELECT o_orderkey, round(least(60.0, 5.0 * pow(2, least(o_orderkey % 40, 30))) * 1.0, 6) AS wait, [o_orderkey, o_orderkey + 1, o_orderkey + 2][o_orderkey % 3 + 1] AS first,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'c' WHEN 2 THEN 'b,c' ELSE 'a,b,c' END AS last FROM orders""")
def waits_and_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    abc = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    last = F.get(F.array(*(F.array_join(scalar.last_n(abc, n), ",") for n in range(4))), (key % 4).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(scalar.backoff(key % 40, 5.0, 60.0, F.lit(0.5)), 6).alias("wait"), scalar.rotated(F.array(key, key + 1, key + 2), key % 3)[0].alias("first"), last.alias("last")
    )


@P.query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN 0.0 WHEN 2 THEN 0.25 WHEN 3 THEN 0.25 ELSE 7.0 END AS score, CASE WHEN user_id % 4 = 0 AND user_id > 0 THEN CAST(user_id AS INTEGER) END AS n FROM events""")
def info_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number, null, none, no number, a number as text; and whole numbers over 0."""
    v = F.col("value").cast("string")
    info = pick(F.col("event_id"), F.concat(F.lit('{"score": '), v, F.lit("}")), '{"score": null}', '{"moves": 3}', '{"score": "high"}', '{"score": "7"}')
    user = F.col("user_id")
    number = F.when(user % 4 == 0, user.cast("string")).when(user % 4 == 1, (-user).cast("string")).when(user % 4 == 2, "many").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", resolve.info_score(info, 0.25).alias("score"), resolve.positive_int(number).alias("n"))


@P.query("""
SELECT 'fam_' || o_custkey || '_' || (o_orderkey % 9) AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'given' ELSE 'fam_' || o_custkey END AS task_family,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE o_orderkey % 9 END AS INTEGER) AS variant FROM orders""")
def scenario_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.lit("").alias("task_id"), F.concat_ws("_", F.lit("fam"), F.col("o_custkey").cast("string"), (key % 9).cast("string")).alias("id"),
        F.when(key % 2 == 0, "given").otherwise("").alias("task_family"), F.when(key % 4 == 0, "7").alias("variant"),
    )
    return resolve.scenario_ref(rows)


@P.query(r"""
SELECT DISTINCT p_type AS task_id, p_type AS task, coalesce(nullif(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'scienceworld') AS task_family, p_size % 4 AS variation_idx, CASE WHEN p_size % 2 = 0 THEN 'easy' ELSE '' END AS simplification,
  CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS recommended_max_steps FROM part""")
def science_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.lit("").alias("task_name"), F.concat(F.lit(""), F.col("p_type")).alias("instruction"), F.lit(" ").alias("family"), (size % 4).alias("variation"),
        F.when(size % 2 == 0, "easy").alias("simplification_str"), (size % 3).cast("string").alias("recommended_max_steps"),
    )
    return resolve.science_ref(rows).distinct()


@P.query("""
SELECT o_orderkey, 'json_2.1.1/' || split || '/t' || o_orderkey AS file, split AS source, CASE split WHEN 'train' THEN 'train' WHEN 'valid_seen' THEN 'eval_in_distribution' WHEN 'valid_unseen' THEN 'eval_out_of_distribution' END AS evaluation
FROM (SELECT o_orderkey, ['train', 'valid_seen', 'valid_unseen', 'other'][o_orderkey % 4 + 1] AS split FROM orders)""")
def canonical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    path = F.concat(pick(key, "/data/x/", "", "C:/y/", "/"), F.lit("json_2.1.1/"), pick(key, "train", "valid_seen", "valid_unseen", "other"), F.lit("/t"), key.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", manifests.canonical_file(path).alias("file"), manifests.source_split(path).alias("source"), manifests.evaluation_split(path).alias("evaluation"))


@P.query("""
SELECT printf('test:%04d', p_partkey) AS id, p_name AS gamefile, ['pick_and_place_simple', 'look_at_obj_in_light', 'pick_clean_then_place_in_recep', 'pick_heat_then_place_in_recep', 'pick_cool_then_place_in_recep', 'pick_two_obj_and_place'][p_partkey % 6 + 1] AS task_type FROM part""")
def canonical_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("gamefile"), pick(F.col("p_partkey"), *manifests.PATH_TASK_TYPES).alias("task_type"))
    return manifests.canonical_test(rows, "p_partkey")


@P.query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'i' || o_orderkey ELSE o_orderpriority END AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE o_orderstatus END AS family, o_orderpriority AS instruction,
  o_orderkey % 5 = 0 OR o_totalprice >= 200000 AS good, CAST(o_orderkey % 50 AS INTEGER) AS steps, o_totalprice / 200000 AS reward FROM orders""")
def result_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields under names that change from row to row."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key, F.when(key % 2 == 0, F.concat(F.lit("i"), key.cast("string"))).otherwise("").alias("id"), F.col("o_orderpriority").alias("task"),
        F.when(key % 3 > 0, F.col("o_orderstatus")).alias("task_type"), (key % 5 == 0).alias("success"), (F.col("o_totalprice") / 200000).alias("score"), (key % 50).alias("steps"),
    )
    return rows.select(
        "o_orderkey", resolve.task_id(rows).alias("task_id"), resolve.family(rows).alias("family"), resolve.instruction(rows).alias("instruction"), resolve.succeeded(rows).alias("good"),
        resolve.step_count(rows).alias("steps"), resolve.final_reward(rows).alias("reward"),
    )


@P.query("""SELECT o_custkey, string_agg(k || '=' || v, ',' ORDER BY k) AS entries FROM (
  SELECT o_custkey, o_orderpriority AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'set' ELSE CAST(max(o_orderkey) AS VARCHAR) END AS v FROM orders GROUP BY 1, 2
  UNION SELECT DISTINCT o_custkey, '1-URGENT', 'set' FROM orders) GROUP BY 1""")
def map_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").cast("string").alias("v"))
    maps = each.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "v"))).alias("m"))
    entries = F.array_sort(F.map_entries(render.upserted(F.col("m"), F.lit("1-URGENT"), F.lit("set"))))
    return maps.select("o_custkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("entries"))


def role_answers(doc: Column, text: Column) -> dict[str, Column]:
    """What each role answers about a document, by its contract: the id in one field, the whole text in another."""
    ids = F.array(doc)
    edit = [F.lit("append").alias("op"), F.lit("").alias("target"), text.alias("content")]
    span = F.struct(doc.alias("task_id"), F.lit(1).alias("start"), F.lit(2).alias("end"))
    found = F.struct(text.alias("pattern"), F.struct(*edit).alias("proposed_edit"), span.alias("trigger_range"))
    cited = F.struct(*edit, ids.alias("evidence_ids"))
    return {
        "judge": F.struct(doc.alias("decision"), text.alias("reason")),
        "extractor": F.struct(F.array(F.struct(text.alias("pattern"), F.struct(*edit).alias("proposed_edit"), F.array(span).alias("trigger_ranges"))).alias("evidence")),
        "merger": F.struct(F.lit("x").alias("reasoning"), F.array(cited).alias("edits")),
        "edit_judge": F.struct(F.lit("accept").alias("decision"), doc.alias("replay_failure_type"), text.alias("reason")),
        "reflector": F.struct(F.lit("x").alias("reason"), cited.alias("revised_edit")),
        "epoch_merger": F.struct(F.lit("x").alias("reasoning"), F.array(F.struct(*edit, ids.alias("evidence_ids"), ids.alias("source_edit_ids"))).alias("merged_edits")),
        "repair": F.struct(F.lit("x").alias("reasoning"), F.array(cited).alias("repair_edits")),
        "ranker": F.struct(ids.alias("selected_edit_ids"), F.array(text).alias("dropped_edit_ids")),
        "coverage": F.struct(F.array(F.struct(doc.alias("evidence_id"), F.lit("keep").alias("decision"), text.alias("reason"))).alias("coverage")),
        "memory": F.struct(doc.alias("reasoning"), text.alias("longitudinal_memory_content")),
        "feedback": F.struct(text.alias("feedback")),
        "contrast_judge": F.struct(F.lit("evidence").alias("decision"), F.lit("x").alias("reason"), found.alias("evidence")),
        "epoch_judge": F.struct(F.lit("evidence").alias("decision"), F.lit("x").alias("reason"), found.alias("evidence")),
    }


#: Where the id and the text are found in the typed answer of a role.
ANSWERED = {
    "judge": ("decision", "reason"),
    "extractor": ("evidence[0].trigger_ranges[0].task_id", "evidence[0].pattern"),
    "merger": ("edits[0].evidence_ids[0]", "edits[0].content"),
    "edit_judge": ("replay_failure_type", "reason"),
    "reflector": ("revised_edit.evidence_ids[0]", "revised_edit.content"),
    "epoch_merger": ("merged_edits[0].source_edit_ids[0]", "merged_edits[0].content"),
    "repair": ("repair_edits[0].evidence_ids[0]", "repair_edits[0].content"),
    "ranker": ("selected_edit_ids[0]", "dropped_edit_ids[0]"),
    "coverage": ("coverage[0].evidence_id", "coverage[0].reason"),
    "memory": ("reasoning", "longitudinal_memory_content"),
    "feedback": ("feedback", "feedback"),
    "contrast_judge": ("evidence.trigger_range.task_id", "evidence.pattern"),
    "epoch_judge": ("evidence.trigger_range.task_id", "evidence.pattern"),
}


@P.query(f"""
WITH r AS (SELECT doc_id, text, [{", ".join(f"'{r}'" for r in ANSWERED)}][doc_id % 13 + 1] AS role, doc_id % 17 = 0 AS torn FROM documents)
SELECT doc_id, role, CASE WHEN torn THEN NULL WHEN role = 'feedback' THEN sha256(text) ELSE 'E' || doc_id END AS said, CASE WHEN NOT torn THEN sha256(text) END AS content FROM r""")
def role_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the answer of one of the thirteen roles, in prose; every seventeenth is torn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("E"), F.col("doc_id").cast("string")).alias("id"))
    out = None
    for i, (role, answer) in enumerate(role_answers(F.col("id"), F.col("text")).items()):
        whole = F.to_json(answer)
        torn = F.when(F.col("doc_id") % 17 == 0, F.substring(whole, F.lit(1), F.char_length(whole) - 1)).otherwise(whole)
        rows = docs.where(F.pmod("doc_id", F.lit(13)) == i).select("doc_id", F.concat(F.lit("Here it is:\n```json\n"), torn, F.lit("\n```")).alias("raw"))
        good, bad = parsing.parse_contract(rows, F.col("raw"), role)
        said, content = (F.expr(f"parsed.{x}") for x in ANSWERED[role])
        said = F.sha2(said, 256) if role == "feedback" else said
        made = good.select("doc_id", F.lit(role).alias("role"), said.alias("said"), F.sha2(content, 256).alias("content"))
        made = made.unionByName(bad.select("doc_id", F.lit(role).alias("role"), F.lit(None).cast("string").alias("said"), F.lit(None).cast("string").alias("content")))
        out = made if out is None else out.unionByName(made)
    return out
