"""Benchmark decontamination by SimHash windows, as native DataFrame operations.

A window is as long as an item. It is placed at every position of a document whose shingle some
item of that length holds, if so many of its shingles belong to items of that length that a
similarity over the threshold is possible. Neither test loses a match: a window that starts with a
shingle the item lacks can move on by one word without sharing less, and a similarity of t asks for
a share of at least t of the item's shingles.

Windows and items get 64-bit SimHash fingerprints over their shingles, weighted by occurrence. Which
item a window meets is found by the multi-index alone: RADIUS + 1 blocks of the fingerprint, of
which two fingerprints within the radius agree in at least one. Candidates are verified exactly by
weighted Jaccard. At the threshold of 0.8, fingerprints of alike windows differ in about 10 of 64
bits (deviation 3), so the radius of 24 keeps all but about one in a million. Its blocks have two or
three bits, which is why windows are placed with care before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.naming import quoted, unused
from tracequarry.operators.membership import likely_members
from tracequarry.session import staged

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 24
#: Shingles of the benchmark up to which they are broadcast (about 40 bytes each); over it, shuffled.
BROADCAST_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; one empty word where there are none."""
    return F.split(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle_at(words: Column, pos: Column, size: int = SHINGLE) -> Column:
    return F.xxhash64(*(F.get(words, pos + k) for k in range(size)))


def sized_shingle_at(words: Column, pos: Column, size: Column, sizes: list[int]) -> Column:
    """The shingle of ``size`` words, which is one of ``sizes``."""
    out = shingle_at(words, pos, sizes[0])
    for k in sizes[1:]:
        out = F.when(size == k, shingle_at(words, pos, k)).otherwise(out)
    return out


def simhash(shingles: str) -> Column:
    """64-bit fingerprint of an array of shingle hashes; each occurrence has weight one."""
    return F.expr(
        f"aggregate(transform(sequence(0, 63), b -> if(2 * aggregate({shingles}, 0, (a, h) -> a + cast(shiftrightunsigned(h, b) & 1 as int))"
        f" > size({shingles}), shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)"
    )


def block_layout(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks that cover 64 bits as evenly as can be."""
    n = radius + 1
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def fingerprint_blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """Array of block values, each marked with its block's number."""
    return F.array(
        *(
            (F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << w) - 1)) + F.lit(i << 32)).cast("long")
            for i, (at, w) in enumerate(block_layout(radius))
        )
    )


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n_items, k, grams, n, fingerprint) per distinct word sequence; item is its least id.

    Shingles have SHINGLE words, those of shorter items all the item's words (k). Items without
    words, null ones included, are left out.
    """
    words = benchmark.select(quoted(id_col).alias("id"), words_of(quoted(text_col)).alias("words")).where(F.element_at("words", 1) != "")
    k = F.least(F.size("words"), F.lit(SHINGLE))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("k")),
        lambda i: sized_shingle_at(F.col("words"), i, F.col("k"), list(range(1, SHINGLE + 1))),
    )
    return (
        words.groupBy("words")
        .agg(F.min("id").alias("item"), F.count(F.lit(1)).alias("n_items"))
        .withColumn("k", k)
        .select("item", "n_items", "k", grams.alias("grams"))
        .select("*", F.size("grams").alias("n"), simhash("grams").alias("fingerprint"))
    )


def placed_windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, threshold: float, broadcast_shingles: int) -> DataFrame:
    """(doc, version, k, n, pos, window): each document's windows that an item of k and n may match.

    ``window`` holds the shingles from word ``pos`` on, n of them or what the document has left.
    """
    facts = items.agg(F.sum("n").alias("total"), F.collect_set("k").alias("sizes")).first()
    sizes = sorted(facts["sizes"]) or [SHINGLE]
    grams = items.select("k", "n", F.explode("grams").alias("gram")).distinct()
    # a table of its own where it is shuffled: a join with an aggregate's output could not split a hot shingle
    grams = F.broadcast(grams) if (facts["total"] or 0) <= broadcast_shingles else staged(grams, "bench-grams")
    keyed = docs.select(quoted(id_col).alias("doc"), F.xxhash64(quoted(text_col)).alias("version"), words_of(quoted(text_col)).alias("words"))
    spread = keyed.select("doc", "version", "words", F.posexplode("words").alias("pos", "word")).where("word <> ''")
    if len(sizes) == 1:
        at = spread.select("doc", "version", "words", "pos", F.lit(sizes[0]).alias("k"))
    else:
        at = spread.select("doc", "version", "words", "pos", F.explode(F.array(*(F.lit(k) for k in sizes))).alias("k"))
    shingled = at.where(F.col("pos") <= F.size("words") - F.col("k")).select(
        "doc", "version", "pos", "k", sized_shingle_at(F.col("words"), F.col("pos"), F.col("k"), sizes).alias("gram")
    )
    hits = shingled.join(grams, ["k", "gram"]).groupBy("doc", "version", "k", "n").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    need = F.ceil(F.col("n") * threshold - 1e-9).cast("int")
    starts = F.filter("at", lambda p, i: F.coalesce(F.get(F.col("at"), i + need - 1) < p + F.col("n"), F.lit(False)))
    found = staged(hits.select("doc", "version", "k", "n", starts.alias("starts")).where(F.size("starts") > 0), "bench-starts")
    texts = docs.select(quoted(id_col).alias("__doc"), F.xxhash64(quoted(text_col)).alias("version"), quoted(text_col).alias("text"))
    wanted = likely_members(texts, "version", found, found.count()).dropDuplicates(["__doc", "version"])
    met = wanted.withColumnRenamed("version", "__version").join(found, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__version") == F.col("version")))
    words = met.select("doc", "version", "k", "n", "starts", words_of(F.col("text")).alias("words"))
    each = words.select("doc", "version", "k", "n", "words", F.explode("starts").alias("pos"))
    last = F.least(F.col("pos") + F.col("n") - 1, F.size("words") - F.col("k"))
    window = F.transform(F.sequence(F.col("pos"), last), lambda i: sized_shingle_at(F.col("words"), i, F.col("k"), sizes))
    return each.select("doc", "version", "k", "n", "pos", window.alias("window"))


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """(doc, version, item, n_items, start_word, similarity): items found in documents.

    One row per document text and item, for its best window, the first of equally good ones.
    Version is the hash of the text. Null texts and texts without words contain nothing; an item of
    fewer words than a shingle is found where all its words stand in order. Repeated rows are
    reported once; ids may be null. Texts of any length are read whole. Without documents or items
    there are no rows. Other columns are ignored.
    """
    items = staged(benchmark_items(benchmark, item_col, "text"), "bench-items")
    windows = staged(placed_windows(docs, items, id_col, text_col, threshold, broadcast_shingles), "bench-windows")
    keys = ["doc", "version", "k", "n", "pos"]
    indexed = items.select("k", "n", "item", "n_items", "fingerprint", F.explode(fingerprint_blocks(F.col("fingerprint"), radius)).alias("block"))
    near = (
        windows.select(*keys, simhash("window").alias("print"))
        .withColumn("block", F.explode(fingerprint_blocks(F.col("print"), radius)))
        .join(indexed, ["k", "n", "block"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))) <= radius)
        .select(*keys, "item", "n_items")
        .distinct()
    )
    mine = windows.select(*(F.col(c).alias(f"__{c}") for c in keys), "window")
    same = F.col("doc").eqNullSafe(F.col("__doc"))
    for c in keys[1:]:
        same = same & (F.col(c) == F.col(f"__{c}"))
    counted = (
        near.join(mine, same)
        .select(*keys, "item", "n_items", F.size("window").alias("size"), F.explode("window").alias("gram"))
        .groupBy(*keys, "item", "n_items", "size", "gram")
        .count()
    )
    weights = items.select("item", F.explode("grams").alias("gram")).groupBy("item", "gram").agg(F.count(F.lit(1)).alias("weight"))
    weights = staged(weights, "bench-weights")
    shared = (
        counted.join(weights, ["item", "gram"])
        .groupBy(*keys, "item", "n_items", "size")
        .agg(F.sum(F.least("count", "weight")).alias("common"))
        .withColumn("similarity", F.col("common") / (F.col("size") + F.col("n") - F.col("common")))
        .where(F.col("similarity") >= threshold)
    )
    best = F.max(F.struct("similarity", (-F.col("pos")).alias("back"))).alias("best")
    return (
        shared.groupBy("doc", "version", "item", "n_items")
        .agg(best)
        .select(
            F.col("doc").alias(id_col),
            "version",
            F.col("item").alias(item_col),
            "n_items",
            (-F.col("best.back")).cast("long").alias("start_word"),
            F.round("best.similarity", 6).alias("similarity"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found; all columns stay as they are.

    Nulls, empty texts, repeated rows and empty tables as in ``contaminations``.
    """
    found = contaminations(docs, benchmark, id_col, text_col, **options)
    doc, version = unused(docs, "doc", "version")
    gone = staged(found.select(quoted(id_col).alias(doc), F.col("version").alias(version)).distinct(), "bench-found")
    same = quoted(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(quoted(text_col)) == F.col(version))
    return docs.join(gone, same, "left_anti")
