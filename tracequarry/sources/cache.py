"""The embedding cache as a bucketed table: lookups and upserts don't shuffle it.

Rows lie in buckets of the key's hash, so a join with cards, which are few beside the cache, moves only
the cards. New rows are appended to the buckets with a higher generation, and the highest generation of a
key wins, which each bucket finds by itself. ``compacted`` writes the table anew, bucket by bucket, once old
generations are worth dropping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("cache_key", "model", "text_hash", "embedding", "generation")


def appended(rows: DataFrame, name: str, path: str, buckets: int, generation: int) -> None:
    """Adds rows to the table of this name at this path, which comes to be with the first; all calls take the same buckets.

    Rows need cache_key and embedding. Those without a key, without a vector or with a null in it are left
    out; of rows with one key in a call, the one with the greatest vector stays. Rows are dealt into buckets
    before they are written, so a bucket gets one file a call.
    """
    spark = rows.sparkSession
    known = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("model", "text_hash")}
    whole = rows.where((F.coalesce("cache_key", F.lit("")) != "") & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    one = F.max(F.struct(F.col("embedding").cast("array<double>").alias("embedding"), known["model"].alias("model"), known["text_hash"].alias("text_hash")))
    made = whole.groupBy("cache_key").agg(one.alias("r")).select("cache_key", "r.model", "r.text_hash", "r.embedding", F.lit(generation).cast("long").alias("generation"))
    writer = made.repartition(buckets, "cache_key").write.format("parquet").bucketBy(buckets, "cache_key").sortBy("cache_key")
    (writer.mode("append") if spark.catalog.tableExists(name) else writer.option("path", path)).saveAsTable(name)


def rows_of(spark: SparkSession, name: str) -> DataFrame:
    """The newest row of each key; the buckets aren't moved."""
    last = F.max_by(F.struct("model", "text_hash", "embedding", "generation"), "generation").alias("r")
    return spark.table(name).groupBy("cache_key").agg(last).select("cache_key", "r.*")


def misses(keyed: DataFrame, name: str) -> DataFrame:
    """Cards, with their cache_key, of which the table has no row. Cards alone are moved; a null key is never there."""
    return keyed.join(keyed.sparkSession.table(name).select("cache_key").hint("merge"), "cache_key", "left_anti")


def hits(keyed: DataFrame, name: str) -> DataFrame:
    """Cards with the newest vector of their key."""
    return keyed.join(rows_of(keyed.sparkSession, name).select("cache_key", "embedding").hint("merge"), "cache_key")


def compacted(spark: SparkSession, name: str, new_name: str, path: str, buckets: int) -> None:
    """A new table with the newest rows alone; with the old one's buckets it is written without a shuffle."""
    rows_of(spark, name).select(*COLUMNS).write.format("parquet").bucketBy(buckets, "cache_key").sortBy("cache_key").option("path", path).saveAsTable(new_name)
