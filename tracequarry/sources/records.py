"""Reading and writing recorded runs: JSON, JSONL, text, Markdown, split files, transcripts, checkpoints."""

from __future__ import annotations

import json
import os
import tempfile
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "long": T.LongType()}


def struct(fields: str) -> T.StructType:
    """Schema from 'name type, ...', without a session."""
    pairs = (f.split() for f in fields.split(","))
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in pairs])


#: Steps of every benchmark; fields that a benchmark lacks are null.
STEP = struct(
    "step int, task string, observation string, thought string, action string, next_observation string, score double, "
    "score_before double, score_after double, score_delta double, reward double, done boolean, bad_step boolean, "
    "execution_ok boolean, task_completed boolean"
)
RESULT = struct(
    "dataset string, mode string, bundle int, task_index int, task_id string, gamefile string, instruction string, "
    "task_family string, variant int, split string, success boolean, score double, final_reward double, steps int"
).add("trajectory", T.ArrayType(STEP))
# fixed values: task types that a path manifest may hold
PATH_TASK_TYPES = (
    "pick_and_place_simple",
    "look_at_obj_in_light",
    "pick_clean_then_place_in_recep",
    "pick_heat_then_place_in_recep",
    "pick_cool_then_place_in_recep",
    "pick_two_obj_and_place",
)


def serialised(rows: DataFrame, column: str) -> DataFrame:
    """A typed column as JSON text, nulls kept; a null stays null."""
    return rows.withColumn(column, F.to_json(column, {"ignoreNullFields": "false"}))


def deserialised(rows: DataFrame, column: str, kind: T.DataType) -> DataFrame:
    """JSON text as a typed column; text that is no such JSON fails the query, null stays null."""
    return rows.withColumn(column, F.from_json(column, kind, {"mode": "FAILFAST"}))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document: an object, or an array of objects as rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a line that is no JSON fails the query."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def read_quarantined(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, raw lines that don't parse): checkpoints survive a torn write."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    good = parsed.where(F.col("v").isNotNull()).select(F.from_json("value", schema).alias("r")).select("r.*")
    return good, parsed.where(F.col("v").isNull()).select(F.col("value").alias("corrupt"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Embedding cache lines (cache_key, embedding, ord); broken ones are skipped. No file, no rows.

    ``ord`` is the place of a line: its file by name, then its place there.
    """
    place = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])
    schema = struct("cache_key string, model string, text_hash string").add("embedding", T.ArrayType(T.DoubleType())).add("ord", place)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    # a block of a file is read in order by one task, whose ids only grow
    spot = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(path).select("value", spot.alias("ord"), F.try_parse_json("value").alias("v"))

    def text(name: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", "string").alias(name)

    vector = F.try_variant_get("v", "$.embedding", "array<double>").alias("embedding")
    found = rows.select(text("cache_key"), text("model"), text("text_hash"), vector, "ord")
    return found.where((F.coalesce("cache_key", F.lit("")) != "") & F.col("embedding").isNotNull())


def read_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, ord) of a line-oriented split file: trimmed, blanks dropped; repeated ids fail."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    ids = lines.select(F.btrim("line").alias("task_id"), F.col("at").alias("ord")).where("task_id <> ''")
    once = ids.groupBy("task_id").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col("task_id")))).otherwise(F.col("task_id"))
    return once.select(checked.alias("task_id"), "ord")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, fingerprint) of whole documents."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("fingerprint", F.sha2("text", 256))


def read_pinned(spark: SparkSession, path: str, pins: dict[str, str]) -> DataFrame:
    """Files with their SHA-256; one that differs from its pin fails the query."""
    table = F.create_map(*(F.lit(x) for kv in pins.items() for x in kv)) if pins else F.create_map().cast("map<string,string>")
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")
    pin = F.try_element_at(table, F.regexp_extract("path", "([^/]*)$", 1))
    checked = F.when(pin.isNotNull() & (pin != F.col("sha256")), F.raise_error(F.concat(F.lit("changed: "), F.col("path")))).otherwise(F.col("sha256"))
    return rows.withColumn("sha256", checked)


def read_path_manifest(spark: SparkSession, root: str, pattern: str, sidecar: str, schema: T.StructType, types: tuple[str, ...] | None = PATH_TASK_TYPES) -> DataFrame:
    """Files found below a root, each with the fields of the sidecar beside it; of task types that aren't among ``types`` none."""
    def found(name: str) -> DataFrame:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
        return rows.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))

    beside = found(sidecar).select("folder", F.from_json(F.col("content").cast("string"), schema).alias("side"))
    met = found(pattern).select(F.col("path").alias("gamefile"), "folder").join(beside, "folder").select("gamefile", "side.*")
    return met if types is None else met.where(F.col("task_type").isin(*types))


def parse_transcript(rows: DataFrame, key: str, text: str, drop_first: str | None = None) -> DataFrame:
    """(key, pos, role, content) of a transcript whose turns start with lines USER: or ASSISTANT:."""
    marked = F.regexp_replace(F.col(text), r"(?m)^(USER|ASSISTANT):", "\x1e$1\x1f")
    turns = F.filter(F.split(marked, "\x1e"), lambda t: t.contains("\x1f"))
    each = rows.select(key, F.posexplode(turns).alias("pos", "turn")).select(
        key, "pos", F.lower(F.split_part("turn", F.lit("\x1f"), F.lit(1))).alias("role"), F.regexp_replace(F.split_part("turn", F.lit("\x1f"), F.lit(2)), r"^\s+|\s+\z", "").alias("content")
    )
    return each if drop_first is None else each.where(~((F.col("pos") == 0) & F.col("content").startswith(drop_first)))


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines with nulls kept; partitions are replaced one by one."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic") if partition_by else writer).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_splits(manifest: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Manifests by split below ``manifests``, and beside them a summary with counts and fingerprints, which is returned."""
    from tracequarry.operators.audit import fingerprint

    manifest.write.mode("overwrite").partitionBy(split).parquet(f"{path}/manifests")
    summary = fingerprint(manifest, F.col("task_id").cast("string"), ["ord"], [split])
    summary.write.mode("overwrite").json(f"{path}/split_manifest")  # a row for each split
    return manifest.sparkSession.read.schema(summary.schema).json(f"{path}/split_manifest")


def save_json(value: Any, path: str) -> None:
    """A small document on the driver, written whole or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(temporary, path)


def write_ledger(rows: DataFrame, path: str, parts: tuple[str, ...] = ("epoch", "bundle")) -> None:
    """Evidence rows as JSON lines by epoch and bundle; only the parts that come are replaced."""
    write_jsonl(rows, path, list(parts))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, description) of apps from a JSON list: nameless ones go, a missing description is empty; 'admin' is left out."""
    rows = read_json(spark, path, struct("name string, description string"))
    named = rows.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"))
    return named.where((F.col("name") != "") & (F.col("name") != "admin"))


def completed(done: DataFrame, todo: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do: keys without a completed row."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
