"""Line de-duplication across documents, as native DataFrame operations.

Long lines are hashed to 128 bits, range-partitioned on (hash, document) and sorted within
partitions by hash, document and position, so a line that a third of all documents hold spans many
partitions. Each task streams its sorted run and marks the first occurrence of a hash in a document.
First occurrences alone make the summary of a hash (how many documents hold it, which one keeps it);
they are combined within each task, so only one row a hash and range travels on to join the ranges
at their edges. Only positions of dropped lines travel back to documents, as a compressed bitmap:
the sorted positions at which "keep" turns to "drop" and back.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from tracequarry.llm.naming import quoted, unused
from tracequarry.operators.membership import likely_members
from tracequarry.session import staged

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ASCII strings take the fast path of ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Documents that lose lines, as (doc, version, flips, n_dropped).

    ``version`` tells texts apart that share an id. ``flips`` is the compressed bitmap: lines
    before flips[0] stay, lines from flips[0] up to flips[1] go, and so on.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents stays
    only in the document with the largest id. Rows of one id count as one document; a null id
    counts as one document, below all others. Null and empty texts hold one empty line, which is
    too short for a key. Repeated rows get the same bitmap. Texts of any length are read whole.
    Without documents there are no rows. Other columns are ignored.
    """
    found = (
        docs.select(
            quoted(id_col).alias("doc"),
            F.xxhash64(quoted(text_col)).alias("version"),
            F.posexplode(lines_of(quoted(text_col))).alias("pos", "line"),
        )
        .where(F.char_length(F.btrim("line", F.lit(WHITE))) >= min_chars)  # as long as its key
        .select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "version", "pos")
    )
    # ranges of (hash, document) hold all of a document's lines of one hash, so this window needs no other shuffle
    in_document = Window.partitionBy("h1", "h2", "doc").orderBy("pos", "version")
    runs = staged(
        found.repartitionByRange("h1", "h2", "doc").withColumn("first", F.row_number().over(in_document) == 1),
        "line-runs",
    )
    # a table of its own: a join with an aggregate's output could not split a hot hash
    repeated = staged(
        runs.where("first")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper"),
        "line-repeated",
    )
    dropped = (
        likely_members(runs, "h1", repeated, repeated.count())
        .join(repeated, ["h1", "h2"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "version")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    gone = F.col("gone")
    edges = F.transform(
        gone,
        lambda p, i: F.array(
            F.when((i == 0) | (F.get(gone, i - 1) != p - 1), p),
            F.when((i == F.size(gone) - 1) | (F.get(gone, i + 1) != p + 1), p + 1),
        ),
    )
    return dropped.select(
        "doc",
        "version",
        F.array_compact(F.flatten(edges)).alias("flips"),
        F.size("gone").cast("long").alias("n_dropped"),
    )


def apply_bitmap(lines: Column, flips: Column) -> Column:
    """The kept lines: the slices between dropped runs; linear in the number of lines."""
    runs = (F.size(flips) / 2).cast("int")
    kept = F.transform(
        F.sequence(F.lit(0), runs),
        lambda k: F.slice(
            lines,
            F.when(k == 0, F.lit(0)).otherwise(F.get(flips, 2 * k - 1)) + 1,
            F.when(k == runs, F.size(lines)).otherwise(F.get(flips, 2 * k))
            - F.when(k == 0, F.lit(0)).otherwise(F.get(flips, 2 * k - 1)),
        ),
    )
    return F.flatten(kept)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    out_col: str = "kept_text",
    counts: bool = True,
) -> DataFrame:
    """All rows and columns of ``docs`` plus n_lines, n_dropped and the kept text.

    Rows that lose nothing keep their text as it is (a null text becomes the empty text). Columns of
    ``docs`` that are called n_lines, n_dropped or like ``out_col`` are replaced by the new ones;
    no other name clashes. Without ``counts`` only the text is added. Nulls, repeated rows and empty tables as in ``keep_bitmaps``.
    """
    maps = keep_bitmaps(docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs)
    doc, version, flips, dropped = unused(docs, "doc", "version", "flips", "dropped")
    maps = maps.select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("flips").alias(flips), F.col("n_dropped").alias(dropped))
    joined = docs.join(maps, quoted(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(quoted(text_col)) == F.col(version)), "left")
    lines = lines_of(quoted(text_col))
    text = F.when(F.col(flips).isNull(), F.coalesce(quoted(text_col), F.lit(""))).otherwise(
        F.array_join(apply_bitmap(lines, F.col(flips)), "\n")
    )
    added = {out_col: text}
    if counts:
        added = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.col(dropped), F.lit(0).cast("long")), **added}
    places = [added.pop(c).alias(c) if c == out_col == text_col else quoted(c) for c in docs.columns if c not in added or c == out_col == text_col]
    return joined.select(*places, *(v.alias(k) for k, v in added.items()))
