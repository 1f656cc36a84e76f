"""Text, hash, JSON and configuration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import scalar
from tracequarry.functions import text as X
from tracequarry.operators import config
from tracequarry.plans.base import Plans, table
from tracequarry.sources import records

P = Plans()


SPELLINGS = [*X.TASK_TYPES, "none", ""]


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@P.query(
    f"""WITH t(i, v) AS (VALUES {", ".join(f"({i}, {sql_text(X.TASK_TYPES.get(k))})" for i, k in enumerate(SPELLINGS))})
SELECT p_partkey, p_size, v AS task_type FROM part JOIN t ON t.i = p_partkey % {len(SPELLINGS)}"""
)
def family_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known spelling, in changing case, with spaces or dashes, and unknown ones."""
    said = F.get(F.array(*(F.lit(x) for x in SPELLINGS)), (F.col("p_partkey") % len(SPELLINGS)).cast("int"))
    n = F.col("p_size") % 4
    said = F.when(n == 0, F.upper(said)).when(n == 1, F.replace(said, F.lit("_"), F.lit("-"))).when(n == 2, F.concat(F.lit("  "), F.initcap(said), F.lit(" !"))).otherwise(said)
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", X.task_type(said).alias("task_type"))


@P.query("""
SELECT c_custkey, CASE WHEN lower(s) LIKE '%desklamp%' OR lower(s) LIKE '%look at%' THEN 'look_at_obj_in_light' WHEN lower(s) LIKE '%wash%' OR lower(s) LIKE '%clean%' THEN 'clean'
  WHEN lower(s) LIKE '%heat%' OR lower(s) LIKE '%warm%' THEN 'heat' WHEN lower(s) LIKE '%fridge%' OR lower(s) LIKE '%cool%' THEN 'cool' WHEN lower(s) LIKE '%inspect%' THEN 'examine' ELSE 'pick_and_place' END AS family
FROM (SELECT c_custkey, ['Put it under the Desklamp', 'wash the heated mug', 'Warm the egg', 'from the FRIDGE', 'inspect it', 'put it there'][c_custkey % 6 + 1] AS s FROM customer)""")
def described_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*(F.lit(x) for x in ("Put it under the Desklamp", "wash the heated mug", "Warm the egg", "from the FRIDGE", "inspect it", "put it there")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(said, (F.col("c_custkey") % 6).cast("int")).alias("said"))
    return rows.select("c_custkey", X.described_family("said").alias("family"))


@P.query(r"""
SELECT p_partkey, coalesce(nullif(regexp_replace(trim(regexp_replace(replace(lower(p_name), '.', ''), '[^a-z0-9]+', '_', 'g'), '_'), '^gpt_', 'gpt'), ''), 'part') AS slug FROM part""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.slug("p_name", "part").alias("slug"))


@P.query(r"""
WITH t AS (SELECT page_id, trim(regexp_replace(CASE WHEN regexp_matches(html, '(?is)<title>(.*?)</title>') THEN regexp_extract(html, '(?is)<title>(.*?)</title>', 1)
  ELSE regexp_replace(html, '<[^>]+>', ' ', 'g') END, '\s+', ' ', 'g')) AS s FROM pages)
SELECT page_id, CASE WHEN length(s) > 60 THEN rtrim(left(s, 60)) || '...' ELSE s END AS summary FROM t""")
def html_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.error_summary("html", 60).alias("summary"))


ASSIGNED = r"(?i)(\b(?:[a-z0-9_]*(?:password|passcode|token|secret|otp|verification_code|api_key|cvv|card_number)[a-z0-9_]*)\b\s*(?::|=)\s*)"


@P.query(rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{ASSIGNED}"([^"\n]*)"', '\1"[REDACTED]"', 'g') AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(t, '{ASSIGNED}\x27([^\x27\n]*)\x27', '\1' || chr(39) || '[REDACTED]' || chr(39), 'g') AS t FROM d)
SELECT doc_id, sha256(regexp_replace(t, '(?i)\bBearer\s+[A-Za-z0-9._~+/=\-]+', 'Bearer [REDACTED]', 'g')) AS text_sha FROM s""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with both kinds of quotes; a null text counts as empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.redact("text"), 256).alias("text_sha"))


@P.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_id", value.alias("k"))


@P.query("""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, upper(role) AS role, sha256(trim(text, ' ' || chr(10))) AS sha FROM conversations WHERE role <> 'system'""")
def transcript_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.upper("role"), F.lit(":\n"), F.col("text"))
    rows = table(spark, sf_dir, "conversations")  # what comes before the first mark belongs to no turn
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    texts = whole.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("raw"))
    return records.parse_transcript(texts, "conv_id", "raw").select("conv_id", "pos", F.upper("role").alias("role"), F.sha2("content", 256).alias("sha"))


@P.query("""
WITH a AS (SELECT 'p.' || p_partkey AS path, CAST(p_size AS VARCHAR) AS v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT 'p.' || p_partkey AS path, CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS v FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.path, b.path) AS path, a.v AS expected, b.v AS actual FROM a FULL JOIN b ON a.path = b.path WHERE a.v IS DISTINCT FROM b.v""")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("p."), F.col("p_partkey").cast("string")))
    want = rows.where("p_partkey % 5 <> 0").select("path", F.col("p_size").cast("string").alias("value"))
    value = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string")
    return config.differences(want, rows.where("p_partkey % 11 <> 0").select("path", value.alias("value")))


@P.query(r"""
SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN role WHEN 1 THEN regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') WHEN 2 THEN 'first' ELSE '' END AS action FROM conversations""")
def tagged_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in any case, over several lines, twice, and without an end."""
    kind = (F.col("conv_id") + F.col("turn")) % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("<think>x</think> <Action>\n "), F.col("role"), F.lit(" </ACTION> tail")))
        .when(kind == 1, F.concat(F.lit("<action>"), F.col("text"), F.lit("\n</action>")))
        .when(kind == 2, F.concat(F.lit("<action>first</action><action>"), F.col("role"), F.lit("</action>")))
        .otherwise(F.concat(F.lit("<action>"), F.col("role")))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tagged(raw, "action").alias("action"))


@P.query("SELECT o_orderkey, 'fam_' || o_custkey AS family, CAST(o_orderkey % 5 AS INTEGER) AS variant FROM orders WHERE o_orderkey % 5 BETWEEN 1 AND 3")
def variant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.concat_ws("_", F.lit("fam"), F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 5).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.variant_id(task).alias("v"))
    return rows.where("v is not null").select("o_orderkey", "v.family", "v.variant")


@P.query("SELECT doc_id, sha256(text) AS fingerprint, 'm:' || sha256(text) AS cache_key, substr(sha1(text), 1, 10) AS short FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", scalar.sha("text").alias("fingerprint"), scalar.cache_key(F.lit("m"), "text").alias("cache_key"), scalar.short_sha1("text").alias("short")
    )


@P.query("""
SELECT doc_id, lang AS region, sha256(rtrim(text) || chr(10) || chr(10) || '<!-- LONGITUDINAL_MEMORY_START -->' || chr(10) || lang || chr(10) || '<!-- LONGITUDINAL_MEMORY_END -->' || chr(10)) AS sha FROM documents""")
def protected_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.with_region("text", "lang").alias("doc"))
    return rows.select("doc_id", X.region("doc").alias("region"), F.sha2("doc", 256).alias("sha"))


SAID = [*scalar.TRANSIENT, *scalar.RETRY_TEXT, "bad request", "not found", ""]


def says(phrases: tuple[str, ...], text: str) -> bool:
    return any(p in text for p in phrases)


@P.query(
    f"""WITH t(i, transient, said) AS (VALUES {", ".join(f"({i}, {says(scalar.TRANSIENT, x)}, {says(scalar.RETRY_TEXT, x)})" for i, x in enumerate(SAID))})
SELECT event_id, transient, event_id % 200 + 400 IN (408, 409, 429) OR event_id % 200 + 400 BETWEEN 500 AND 599 OR said AS retryable FROM events JOIN t ON t.i = event_id % {len(SAID)}"""
)
def transport_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known phrase, in upper case inside a sentence, and some that say nothing."""
    said = F.get(F.array(*(F.lit(x) for x in SAID)), (F.col("event_id") % len(SAID)).cast("int"))
    said = F.concat(F.lit("Error: "), F.upper(said), F.lit(" (try again)"))
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("said"), (F.col("event_id") % 200 + 400).alias("status"))
    return rows.select("event_id", scalar.transient_error("said").alias("transient"), scalar.retryable("status", "said").alias("retryable"))
