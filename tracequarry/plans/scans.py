"""Queries that write with a sink and read back with a source, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import scalar
from tracequarry.operators import audit, cards, embed
from tracequarry.plans.base import Plans, table
from tracequarry.session import shared_folder
from tracequarry.sources import manifests, records

P = Plans()


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tracequarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@P.query("""
SELECT CAST(o_orderkey AS INTEGER) AS task_index, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS mode, o_orderkey % 2 = 0 AS success, o_totalprice AS score, o_orderpriority || ' "x"' || chr(10) AS instruction FROM orders""")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with nulls, quotes and line breaks, as JSON lines and back."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key.cast("int").alias("task_index"), F.when(key % 3 > 0, F.col("o_orderstatus")).alias("mode"), (key % 2 == 0).alias("success"), F.col("o_totalprice").alias("score"),
        F.concat("o_orderpriority", F.lit(' "x"\n')).alias("instruction"),
    )
    path = place(spark, "jsonl")
    records.write_jsonl(rows, path)
    return records.read_jsonl(spark, path, records.RESULT).select("task_index", "mode", "success", "score", "instruction")


@P.query("""
SELECT CAST(event_id AS INTEGER) AS step, event_type AS action, NULL AS corrupt FROM events WHERE event_id % 10 <> 7
UNION ALL SELECT NULL, NULL, '{"step": ' || event_id FROM events WHERE event_id % 10 = 7""")
def quarantine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of which every tenth line was torn, and those lines."""
    whole = F.to_json(F.struct(F.col("event_id").alias("step"), F.col("event_type").alias("action")))
    line = F.when(F.col("event_id") % 10 == 7, F.concat(F.lit('{"step": '), F.col("event_id").cast("string"))).otherwise(whole)
    path = place(spark, "steps")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    good, torn = records.read_quarantined(spark, path, records.STEP)
    none = F.lit(None)
    return good.select("step", "action", none.cast("string").alias("corrupt")).unionByName(torn.select(none.cast("int").alias("step"), none.cast("string").alias("action"), "corrupt"))


@P.query("""
SELECT 'k' || (doc_id % 500) AS cache_key, CAST(max(doc_id) AS DOUBLE) AS x FROM documents WHERE doc_id % 11 > 0 GROUP BY 1""")
def cache_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache lines in one ordered file, some of them broken; the last line of a key wins."""
    n = F.col("doc_id")
    entry = F.to_json(F.struct(F.concat(F.lit("k"), (n % 500).cast("string")).alias("cache_key"), F.array(n.cast("double"), F.lit(1.0)).alias("embedding")))
    broken = F.when(n % 22 == 0, '{"cache_key": "k1", "embedding": [1').otherwise('{"cache_key": "", "embedding": [1.0]}')
    path = place(spark, "cache")
    table(spark, sf_dir, "documents").select("doc_id", F.when(n % 11 > 0, entry).otherwise(broken).alias("value")).coalesce(1).sortWithinPartitions("doc_id").select("value").write.text(path)
    return embed.latest_cache(records.read_cache(spark, path), "ord").select("cache_key", F.col("embedding")[0].alias("x"))


@P.query("SELECT 'task_' || s_suppkey AS task_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier")
def split_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split file with spaces and blank lines: its ids in order."""
    line = F.concat(F.lit(" task_"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(" \n")).otherwise(""))
    path = place(spark, "split")
    table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("value")).coalesce(1).sortWithinPartitions("s_suppkey").select("value").write.text(path)
    found = records.read_split_ids(spark, path)  # one file of one split
    return audit.positions(found, "task_id", ["ord"]).select(F.col("value").alias("task_id"), "pos")


@P.query("SELECT p_type, count(*) AS n, sha256(string_agg(CAST(p_partkey AS VARCHAR), chr(10) ORDER BY p_partkey)) AS fingerprint FROM part GROUP BY 1")
def split_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary written beside the manifests of each split."""
    rows = table(spark, sf_dir, "part").select("p_type", F.col("p_partkey").alias("task_id"), F.col("p_partkey").alias("ord"))
    return records.write_splits(rows, place(spark, "manifests"), "p_type")


@P.query("SELECT o_orderkey, 1 AS times FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 4 = 0")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "appended")
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    records.append_rows(rows.withColumn("times", F.lit(1)), path)
    records.append_rows(rows.where("o_orderkey % 4 = 0").withColumn("times", F.lit(2)), path)
    return spark.read.parquet(path)


@P.query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def remaining_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return records.completed(done, table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])


def brand_files(spark: SparkSession, sf_dir: str, name: str, value: Column) -> str:
    """A folder with one text file for each brand of parts, which holds an aggregate of its rows."""
    path = place(spark, name)
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(value.alias("value"))
    rows.repartition("p_brand").write.partitionBy("p_brand").text(path)
    return path


def parts_list() -> Column:
    return F.to_json(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").cast("int").alias("task_index"), F.col("p_name").alias("instruction"), F.col("p_retailprice").alias("score")))))

def brand_of(path: str) -> Column:
    """Of a path, which may be encoded once or twice."""
    return F.url_decode(F.url_decode(F.regexp_extract(path, "p_brand=([^/]*)/", 1)))


@P.query("SELECT CAST(p_partkey AS INTEGER) AS task_index, p_name AS instruction, p_retailprice AS score FROM part")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents that are lists, one for each brand."""
    return records.read_json(spark, brand_files(spark, sf_dir, "json", parts_list()), records.RESULT).select("task_index", "instruction", "score")


@P.query("SELECT '/games/' || p_brand || '/' || p_partkey || '.tw' AS gamefile, p_type AS task_type FROM part")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    game = F.concat(F.lit("/games/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".tw"))
    rows = F.to_json(F.collect_list(F.struct(game.alias("gamefile"), F.col("p_type").alias("task_type"))))
    return manifests.read_manifest(spark, brand_files(spark, sf_dir, "manifest", rows)).select("gamefile", "task_type")


def names_of_parts() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda r: F.concat(F.lit("# "), r["p_name"])), "\n")


NAMES_SQL = "SELECT p_brand AS brand, string_agg('# ' || p_name, chr(10) ORDER BY p_partkey, p_name) || chr(10) AS text FROM part GROUP BY 1"


@P.query(f"SELECT brand, sha256(text) AS fingerprint, length(text) AS n_chars FROM ({NAMES_SQL})")
def markdown_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.read_markdown(spark, brand_files(spark, sf_dir, "markdown", names_of_parts()) + "/*/*.txt")
    return found.select(brand_of("path").alias("brand"), "fingerprint", F.char_length("text").cast("long").alias("n_chars"))


@P.query(f"SELECT brand, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM ({NAMES_SQL})")
def pinned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.read_pinned(spark, brand_files(spark, sf_dir, "pinned", names_of_parts()) + "/*/*.txt", {"other.txt": "0" * 64})
    return found.select(brand_of("path").alias("brand"), "sha256", F.octet_length("content").cast("long").alias("n_bytes"))


@P.query("""
SELECT brand, task_type FROM (SELECT p_brand AS brand, CASE WHEN max(p_partkey) % 2 = 0 THEN 'pick_and_place_simple' ELSE 'walk_around' END AS task_type FROM part GROUP BY 1) WHERE task_type <> 'walk_around'""")
def path_manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with a file and, beside it, a sidecar for each brand; task types that aren't known are left out."""
    root = brand_files(spark, sf_dir, "tree", F.max(F.lit("game")))
    kind = F.when(F.max("p_partkey") % 2 == 0, "pick_and_place_simple").otherwise("walk_around")
    table(spark, sf_dir, "part").groupBy("p_brand").agg(kind.alias("task_type")).repartition("p_brand").write.mode("append").partitionBy("p_brand").json(root)
    found = records.read_path_manifest(spark, root, "*.txt", "*.json", records.struct("task_type string"))
    return found.select(brand_of("gamefile").alias("brand"), "task_type")


@P.query("SELECT p_brand AS name, min(p_name) AS description FROM part WHERE p_brand NOT LIKE '%1' GROUP BY 1")
def app_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as apps; those that end in 1 stand for the one left out."""
    name = F.when(F.max("p_brand").endswith("1"), "admin").otherwise(F.max("p_brand"))
    entry = F.to_json(F.array(F.struct(name.alias("name"), F.min("p_name").alias("description")), F.struct(F.lit("").alias("name"), F.lit("nameless").alias("description"))))
    return records.read_catalogue(spark, brand_files(spark, sf_dir, "apps", entry))


@P.query("SELECT o_orderkey AS evidence_id, o_orderpriority AS pattern, CAST(year(o_orderdate) AS INTEGER) AS epoch, CAST(o_custkey % 4 AS INTEGER) AS bundle, CASE WHEN o_custkey % 4 = 2 THEN 2 ELSE 1 END AS round FROM orders")
def evidence_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger by epoch and bundle, of which one bundle is written again."""
    path = place(spark, "ledger")
    bundle = (F.col("o_custkey") % 4).cast("int")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("pattern"), F.year("o_orderdate").alias("epoch"), bundle.alias("bundle"), F.lit(1).alias("round"))
    records.write_ledger(rows, path)
    records.write_ledger(rows.where("bundle = 2").withColumn("round", F.lit(2)), path)
    return spark.read.schema(rows.schema).json(path).select("evidence_id", "pattern", "epoch", "bundle", "round")


@P.query("SELECT doc_id AS evidence_id, lang AS pattern FROM documents")
def public_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cards.public(docs.select(F.col("doc_id").alias("evidence_id"), F.col("lang").alias("pattern"), F.col("text").alias("_text"), F.col("source").alias("_source")))


@P.query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice >= 100000 ELSE o_orderstatus = 'F' END AS success FROM orders")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes: those in part have no flag, and their price decides."""
    flag = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.episode_success(flag, F.col("o_totalprice"), 100_000.0).alias("success"))
