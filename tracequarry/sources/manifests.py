"""Task manifests: checked scans, identities of files, siblings, counts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.text import variant_id
from tracequarry.sources.records import PATH_TASK_TYPES, read_json, read_split_ids, struct

# fixed values: the folder that roots a file's identity, and tasks per official split
ROOT = "json_2.1.1"
SPLIT_SIZES = {"train": 90, "dev": 57, "test_normal": 168, "test_challenge": 417}
PATH_MANIFEST = struct("id string, task_id string, gamefile string, task_type string, task_family string")


def canonical_file(path: Column) -> Column:
    """A file's identity, without what lies above its root folder."""
    found = F.regexp_extract(path, rf"(?:^|/)({ROOT.replace('.', '[.]')}(?:/.*)?)$", 1)
    return F.when(found != "", found).otherwise(path)


def source_split(path: Column) -> Column:
    """Folder below the root; 'unknown' for a file outside of it."""
    found = F.regexp_extract(canonical_file(path), rf"^{ROOT.replace('.', '[.]')}/([^/]+)", 1)
    return F.when(found != "", found).otherwise("unknown")


def evaluation_split(path: Column) -> Column:
    """Which evaluation a file belongs to, by its folder."""
    path = F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""))
    return (
        F.when(path.contains("/valid_unseen/"), "eval_out_of_distribution").when(path.contains("/valid_seen/"), "eval_in_distribution").when(path.contains("/train/"), "train")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A path manifest; a row without a gamefile fails the query."""
    rows = read_json(spark, path, PATH_MANIFEST)
    checked = F.when(F.coalesce("gamefile", F.lit("")) == "", F.raise_error(F.lit("manifest row without gamefile"))).otherwise(F.col("gamefile"))
    return rows.withColumn("gamefile", checked)


def canonical_test(rows: DataFrame, position: str) -> DataFrame:
    """Test rows with ids by position; an unknown task type fails the query."""
    known = F.col("task_type").isin(*PATH_TASK_TYPES)
    checked = F.when(F.coalesce(known, F.lit(False)), F.col("task_type")).otherwise(F.raise_error(F.concat(F.lit("unknown task type "), F.coalesce("task_type", F.lit("null")))))
    return rows.select(F.format_string("test:%04d", F.col(position).cast("int")).alias("id"), "gamefile", checked.alias("task_type"))


def official_split(spark: SparkSession, data_dir: str, split: str, sidecars: DataFrame) -> DataFrame:
    """Tasks of a split file in order, with family and variant; each needs a sidecar (task_id rows)."""
    ids = read_split_ids(spark, f"{data_dir}/datasets/{split}.txt").withColumn("v", variant_id("task_id"))
    beside = sidecars.select(F.col("task_id").alias("__id")).distinct()
    met = ids.join(beside, F.col("task_id") == F.col("__id"), "left")
    wrong = F.when(F.col("v").isNull(), F.lit("invalid id ")).when(F.col("__id").isNull(), F.lit("no files for "))
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col("task_id")))).otherwise(F.col("task_id"))
    return met.select("ord", checked.alias("task_id"), F.col("v.family").alias("task_family"), F.col("v.variant").alias("variant"), F.lit(split).alias("split"))


def data_root(value: str) -> str:
    """The folder that holds tasks and datasets: the given one or its data folder."""
    for path in (Path(value).expanduser(), Path(value).expanduser() / "data"):
        if (path / "tasks").is_dir() and (path / "datasets").is_dir():
            return str(path.resolve())
    raise FileNotFoundError(f"no tasks and datasets in {value}")


def count_of(path: str | None) -> int | None:
    """Rows of a manifest that is a JSON list; None for anything else."""
    try:
        rows = json.loads(Path(path or "").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return len(rows) if isinstance(rows, list) else None


def sibling(path: str | None, split: str) -> str | None:
    """The manifest of another split beside this one, if it exists."""
    if not path:
        return None
    p = Path(path)
    names = ("val", "dev", "validation", "selection") if split == "val" else (split,)
    for name in names:
        for candidate in (p.parent.parent / name / "items.json", p.with_name(f"{name}.json"), p / name / "items.json", p / f"{name}.json"):
            if candidate.is_file() and candidate != p:
                return str(candidate)
    return None


def target_count(size: int, available: int | None) -> int | None:
    """Tasks of a selection: at most ``size``; 0 or less takes all there are."""
    if size <= 0:
        return available
    return size if available is None else min(size, available)
