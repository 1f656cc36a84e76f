"""Connected components of large edge tables, by alternating stars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import staged

#: A node with more than this share of all edges is a hub; there are fewer than twice as many hubs.
HUB_SHARE = 1000
#: Tables of fewer edges need no split.
LEAST_EDGES = 2_000
#: Edges that one task may join.
FEW_EDGES = 200_000


def met(rows: DataFrame, least: DataFrame, key: str, edges: int) -> DataFrame:
    """``rows`` with the least neighbour ``m`` of their ``key``; rows of hubs stay where they are.

    ``least`` has key, m and degree. No more than 2 x HUB_SHARE nodes can have so many edges, so
    their part is broadcast and no task gets a hub's rows.
    """
    if edges < LEAST_EDGES:
        return rows.join(least.drop("degree"), key)
    most = edges // HUB_SHARE
    hubs = least.where(F.col("degree") > most).select(key, F.col("m").alias("hub_m"))
    known = rows.join(F.broadcast(hubs), key, "left")
    rest = known.where(F.col("hub_m").isNull()).drop("hub_m").join(least.where(F.col("degree") <= most).drop("degree"), key)
    return known.where(F.col("hub_m").isNotNull()).withColumnRenamed("hub_m", "m").unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node it reaches.

    Each round hangs the larger neighbours of a node, then its smaller ones, onto the least of
    them. Edges never outnumber those given, minima are combined before the shuffle, hubs are
    joined without one, and rounds grow with the logarithm of the longest path until nothing
    changes. Loops, nulls and repeated edges are ignored.
    """
    now = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "star",
    )
    mark, count = None, now.count()
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            now.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("degree")).select("x", F.least("x", "m").alias("m"), "degree")
        large = met(both.where(F.col("y") > F.col("x")), least, "x", count).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = met(large, least, "u", count)
        now = staged(
            small.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "star",
        )
        before, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        count = mark[0]
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def joined_groups(edges: DataFrame, a: str, b: str, most: int = FEW_EDGES) -> DataFrame:
    """(node, root) as ``components`` gives them; few edges are joined in one task, many in rounds."""
    if edges.count() > most:
        return components(edges, a, b)
    kind = edges.schema[a].dataType.simpleString()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict = {}

        def root(g):
            while up.setdefault(g, g) != g:
                up[g] = up[up[g]]
                g = up[g]
            return g

        for x, y in zip(pdf[a].tolist(), pdf[b].tolist(), strict=True):
            x, y = sorted((root(x), root(y)))
            up[y] = x
        return pd.DataFrame({"node": list(up), "root": [root(g) for g in up]})

    return edges.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: join(pdf), f"node {kind}, root {kind}")
