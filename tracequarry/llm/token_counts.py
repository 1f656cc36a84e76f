"""Token counts and the exact length histogram.

Documents are encoded whole; only their lengths are kept, as one row per distinct length. Suffix
sums over that histogram answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BLOCK = 1024


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text))


def token_length(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; null texts have none. Special tokens' strings are plain text."""

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for texts in batches:
            yield pd.Series([0 if t is None else len(encode(t)) for t in texts], dtype="int64")

    return lengths(text)


def length_histogram(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """One row per distinct length (and group): n_tokens, n_docs. An empty table has no rows.

    Null and empty texts have length 0; repeated rows count each; texts of any length are encoded
    whole. A null group is a group of its own. Groups can't be called n_tokens or n_docs; other
    columns don't take part.
    """
    return (
        docs.select(*by, token_length(F.col(text_col), path).alias("n_tokens"))
        .groupBy(*by, "n_tokens")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


def suffix_sums(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per length L: documents and tokens at or over L, totals, and what a limit of L keeps.

    ``truncated_tokens`` is the total of min(length, L); ``docs_le`` is the rank whose quantile
    is L. Sums run within blocks of lengths, then over the blocks' totals, so no task holds the
    whole histogram. An empty histogram gives no rows.
    """
    block = (F.col("n_tokens") / BLOCK).cast("long")
    rows = histogram.withColumn("__block", block).withColumn("__tokens", F.col("n_docs") * F.col("n_tokens"))
    keys = [*by, "__block"]
    later = Window.partitionBy(*by, (F.col("__block") * 0).alias("all")).orderBy(F.desc("__block"))
    blocks = (
        rows.groupBy(*keys)
        .agg(F.sum("n_docs").alias("block_docs"), F.sum("__tokens").alias("block_tokens"))
        .select(
            *(F.col(k).alias(f"__{k}") for k in keys),
            (F.sum("block_docs").over(later) - F.col("block_docs")).alias("docs_after"),
            (F.sum("block_tokens").over(later) - F.col("block_tokens")).alias("tokens_after"),
            F.sum("block_docs").over(later.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total_docs"),
            F.sum("block_tokens").over(later.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total_tokens"),
        )
    )
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    inside = Window.partitionBy(*keys).orderBy(F.desc("n_tokens"))
    joined = rows.join(blocks, on).withColumns(
        {
            "docs_ge": F.col("docs_after") + F.sum("n_docs").over(inside),
            "tokens_ge": F.col("tokens_after") + F.sum("__tokens").over(inside),
        }
    )
    return joined.select(
        *by,
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_tokens"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for arbitrary context limits, from ``suffix_sums`` without groups.

    The first length at or over a limit carries all that is needed; limits over the longest
    document keep everything. An empty table has no rows.
    """
    asked = F.explode(F.array(*(F.lit(int(x)) for x in sorted(set(limits))))).alias("context")
    pairs = sums.select("*", asked)
    return pairs.groupBy("context").agg(
        F.max("total_tokens").alias("total_tokens"),
        F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.col("n_docs") * F.least("n_tokens", "context")).alias("kept_tokens"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length whose rank reaches each share of the documents."""
    pairs = sums.select("*", F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share"))
    return (
        pairs.where(F.col("docs_le") >= F.ceil(F.col("share") * F.col("total_docs")))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
