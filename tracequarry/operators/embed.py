"""Embeddings: cache lookups, a deterministic encoder, neighbours, semantic groups, windows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.scalar import cache_key, unit
from tracequarry.operators import density, scan
from tracequarry.operators.graph import joined_groups
from tracequarry.operators.metric import BLOCK, nearest
from tracequarry.session import staged


def hashing_encoder(texts: list[str], width: int = 64) -> list[list[float]]:
    """Offline stand-in for a model: signed hashed word counts."""
    out = []
    for t in texts:
        v = [0.0] * width
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % width] += 1.0 if h >> 31 else -1.0
        out.append(v)
    return out


def latest_cache(rows: DataFrame, order: str) -> DataFrame:
    """Cache rows that are whole; the last row of a key wins."""
    good = rows.where((F.coalesce("cache_key", F.lit("")) != "") & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    return good.groupBy("cache_key").agg(F.max_by("embedding", order).alias("embedding"))


def cache_split(cards: DataFrame, text: Column, model: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their embedding, misses without)."""
    keyed = cards.withColumn("cache_key", cache_key(F.lit(model), text))
    return keyed.join(cache.select("cache_key", "embedding"), "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def encode_cached(cards: DataFrame, text: str, model: str, cache: DataFrame, encoder: Callable[[list[str]], list[list[float]]] = hashing_encoder, batch: int = 32) -> DataFrame:
    """Cards with cache_key, unit embedding and whether it came from the cache; equal texts are encoded once."""
    hits, misses = cache_split(cards, F.col(text), model, cache)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(pdf), batch):
                part = list(pdf["text"][at : at + batch])
                made = encoder(part)
                if len(made) != len(part):
                    raise ValueError("the encoder returned another number of vectors")
                vectors += made
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "embedding": vectors})

    new = misses.select("cache_key", F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["cache_key"])
    made = new.mapInPandas(run, "cache_key string, embedding array<double>")
    found = hits.withColumns({"embedding": F.col("embedding").cast("array<double>"), "cached": F.lit(True)})
    fresh = misses.join(made, "cache_key").withColumn("cached", F.lit(False))
    return found.unionByName(fresh.select(*found.columns)).withColumn("embedding", unit("embedding"))


def cache_stats(encoded: DataFrame, model: str) -> DataFrame:
    """One row: model, hits, misses and count of what ``encode_cached`` returned."""
    hit = F.coalesce(F.sum(F.col("cached").cast("long")), F.lit(0))
    return encoded.agg(F.lit(model).alias("model"), hit.alias("hits"), (F.count(F.lit(1)) - hit).alias("misses"), F.count(F.lit(1)).alias("count"))


def top_neighbours(vectors: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """The k most alike others of each vector, exactly: ``nearest`` of the table to itself."""
    return nearest(vectors, vectors, key, vector, k, block)


def merged_by_centroid(vectors: DataFrame, key: str, group: str, vector: str, least: int = 4, threshold: float = 0.58) -> DataFrame:
    """(key, group): groups of fewer than ``least`` vectors join the large group whose centroid is most alike.

    A small group stays as it is where no large one reaches the threshold; of equally alike ones the least
    is taken. Centroids meet in blocks.
    """
    middle = staged(centroids(vectors, group, vector), "centroids")
    best = nearest(middle.where(F.col("n") < least), middle.where(F.col("n") >= least), group, "centroid", 1)
    best = best.where(F.col("cosine") >= threshold).select(F.col(group).alias("__from"), F.col("neighbour").alias("__to"))
    met = vectors.join(best, F.col(group) == F.col("__from"), "left")
    return met.select(key, F.coalesce("__to", F.col(group)).alias(group))


def mutual_edges(neighbours: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, cosine) with a < b: pairs that are among each other's nearest and alike enough."""
    n = neighbours.where(F.col("cosine") >= threshold).select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b"), "cosine")
    return n.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine")).where("n = 2").drop("n")


def semantic_groups(vectors: DataFrame, key: str, vector: str, k: int = 8, threshold: float = 0.68) -> DataFrame:
    """(key, grp): components of the mutual neighbour graph; a vector without an edge is its own group."""
    edges = staged(mutual_edges(top_neighbours(vectors, key, vector, k), key, threshold), "mutual")
    found = joined_groups(edges, "a", "b").withColumnRenamed("node", key)
    return vectors.select(key).join(found, key, "left").select(key, F.coalesce("root", F.col(key)).alias("grp"))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): unit mean of each group's vectors."""
    each = vectors.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    means = each.groupBy(group, "dim").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    rows = means.groupBy(group).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d"))
    return rows.select(group, "n", unit(F.transform("d", lambda p: p["x"])).alias("centroid"))


def pack_windows(groups: DataFrame, key: str, group: str, least: int = 4, most: int = 20, at_once: int = scan.MOST) -> DataFrame:
    """(key, window): groups cut into windows of at most ``most``, evenly; small ones share one.

    Groups under ``least`` are merged, never dropped. (This rule is ours.) A group, or the small ones
    together, that hold more than ``at_once`` rows are ranked within ranges.
    """
    sized = groups.join(groups.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)
    home = F.when(F.col("n") < least, F.lit("small")).otherwise(F.concat(F.lit("g"), F.col(group).cast("string")))
    return cut_windows(sized.withColumn("home", home), key, "home", [group, key], most, at_once)


def cut_windows(rows: DataFrame, key: str, home: str, order: list[str], most: int, at_once: int = scan.MOST) -> DataFrame:
    """(key, window): each home's rows in order, cut evenly into as few windows of at most ``most`` as will do."""
    placed = scan.ranked(rows, home, order, at_once)
    at, size = F.col("rn") - 1, F.col("rn") + F.col("rev") - 1
    return placed.select(key, F.concat_ws(":", home, F.floor(at * F.ceil(size / most) / size).cast("string")).alias("window"))


#: Datasets whose cards are grouped by round where the mode is 'auto'.
BY_ROUND = ("scienceworld",)


def evidence_windows(cards: DataFrame, key: str, order: str, mode: str = "auto", *, dataset: str = "", rounds: str = "round", vector: str = "embedding", clustering: str = "hdbscan", least: int = 4, most: int = 20, threshold: float = 0.68, merge: float = 0.58, k: int = 8, min_size: int = 5, min_samples: int = 5) -> DataFrame:
    """(key, window): evidence cards grouped for editing. No card is left out.

    'card' cuts the cards in their order, 'round' those of each round, 'semantic' groups of like vectors;
    'auto' is 'round' for the datasets in ``BY_ROUND``, else 'card'. Semantic groups are density clusters
    ('hdbscan') or components of mutual neighbours ('graph'). Cards in none are groups of one, as are those
    without a vector; groups under ``least`` join the large one that is most alike, where that reaches
    ``merge``, and what is still small shares windows. (How windows are cut is our rule.)
    """
    if mode == "auto":
        mode = "round" if dataset.lower() in BY_ROUND else "card"
    if mode == "card":
        return cut_windows(cards.select(key, order).withColumn("home", F.lit("card")), key, "home", [order, key], most)
    if mode == "round":
        home = F.concat(F.lit("r"), F.coalesce(F.col(rounds).cast("string"), F.lit("")))
        return cut_windows(cards.select(key, order, home.alias("home")), key, "home", [order, key], most)
    if mode != "semantic" or clustering not in ("hdbscan", "graph"):
        raise ValueError(f"unknown grouping {mode} {clustering}")
    if clustering == "graph":
        found = semantic_groups(cards, key, vector, k, threshold)
    else:
        found = density.density_groups(cards, key, vector, min_size, min_samples).select(key, "grp")
    grouped = staged(cards.select(key, vector).join(found, key, "left").withColumn("grp", F.coalesce("grp", key)), "evidence-groups")
    return pack_windows(merged_by_centroid(grouped, key, "grp", vector, least, merge), key, "grp", least, most)
