"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A min-cost
flow routes the token capacity of patterns to the quotas of sources; the k-th pass over a
pattern's documents costs k, so repetition is convex and used only where needed. Within a
pattern, documents are taken in a seeded order; the two-level prefix sum over that order never
puts a whole source into one task.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracequarry.session import staged

WORD = "[^\\x20\\x09-\\x0D]+"
BITS = 12
MAX_PATTERNS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_shares(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; a share stops at ``cap`` times its size, the excess is reshared."""
    shares: list[float] = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(total)
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * left / whole > cap * sizes[i]]
        if not over:
            for i in free:
                shares[i] = weights[i] * left / whole
            break
        for i in over:
            shares[i] = float(cap * sizes[i])
        free -= set(over)
        left -= sum(shares[i] for i in over)
    return shares


def route(capacity: list[int], members: list[list[int]], quota: list[int], passes: int) -> list[dict[int, int]]:
    """Min-cost flow: words that each pattern gives to each of its sources.

    All costs lie on a pattern's passes, so augmenting in the order of the passes, with
    rerouting, is the successive shortest path method.
    """
    given: list[dict[int, int]] = [{s: 0 for s in m} for m in members]
    takers: list[list[int]] = [[] for _ in quota]
    for p, m in enumerate(members):
        for s in m:
            takers[s].append(p)
    need = list(quota)
    for _ in range(passes):
        spare = list(capacity)
        for p in range(len(capacity)):
            while spare[p] > 0:
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None}
                queue, end = deque([("p", p)]), None
                while queue and end is None:
                    kind, x = queue.popleft()
                    if kind == "p":
                        for s in members[x]:
                            if ("s", s) not in came:
                                came["s", s] = (kind, x)
                                if need[s] > 0:
                                    end = ("s", s)
                                    break
                                queue.append(("s", s))
                    else:
                        for other in takers[x]:
                            if given[other][x] > 0 and ("p", other) not in came:
                                came["p", other] = (kind, x)
                                queue.append(("p", other))
                if end is None:
                    break
                path, node = [end], came[end]
                while node is not None:
                    path.append(node)
                    node = came[node]
                path.reverse()
                amount = min(spare[p], need[end[1]])
                for (ka, a), (_, b) in zip(path, path[1:], strict=False):
                    if ka == "s":
                        amount = min(amount, given[b][a])
                for (ka, a), (_, b) in zip(path, path[1:], strict=False):
                    if ka == "p":
                        given[a][b] += amount
                    else:
                        given[b][a] -= amount
                spare[p] -= amount
                need[end[1]] -= amount
    return given


def mix(
    docs: DataFrame,
    size: Column,
    members: Column,
    id_col: str = "doc_id",
    *,
    weights: tuple[float, ...] = (3, 1, 2),
    ratio: float = 1.5,
    passes: int = 2,
    seed: int = 7,
    max_patterns: int = MAX_PATTERNS,
) -> tuple[DataFrame, dict[str | None, dict[str, float]]]:
    """(one row per document with the words taken, what each source got).

    ``size`` and ``members`` are columns over ``docs``; ``members`` is an array of sources, of
    which a null element is a source of its own. Sources are ordered by code point, null last,
    and weigh ``weights`` in turn. Patterns are gathered to the driver; more than
    ``max_patterns`` of them are refused, so neither that nor the joined table can grow past it.
    Documents without members or of size 0 are kept and take nothing. Repeated rows count each.
    Ids may be null; order then falls back on the size.
    """
    sized = staged(
        docs.select(
            F.col(id_col).alias("doc"),
            size.alias("size"),
            F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"}).alias("pattern"),
            F.array_sort(F.array_distinct(members)).alias("held"),
        ).withColumn(
            "lot",
            F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long"),
        ),
        "mix-sized",
    )
    spark = docs.sparkSession
    rows = sized.groupBy("pattern", "held").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    rows = sorted(rows, key=lambda r: r["pattern"] or "")
    names = sorted({s for r in rows for s in r["held"] or () if s is not None})
    names += [None] if any(s is None for r in rows for s in r["held"] or ()) else []
    at = {s: i for i, s in enumerate(names)}
    linked = [[at[s] for s in r["held"] or ()] for r in rows]
    whole = [0] * len(names)
    for r, m in zip(rows, linked, strict=True):
        for s in m:
            whole[s] += r["size"]
    factors = [float(weights[i % len(weights)]) for i in range(len(names))]
    targets = capped_shares(whole, factors, ratio * sum(r["size"] for r in rows), passes)
    flows = route([r["size"] for r in rows], linked, [int(t + 0.5) for t in targets], passes)
    report = {
        s: {"size": whole[i], "target": targets[i], "taken": sum(f.get(i, 0) for f in flows)} for s, i in at.items()
    }
    plan = spark.createDataFrame(
        [
            (r["pattern"], sum(f.values()) // r["size"] if r["size"] else 0, sum(f.values()) % r["size"] if r["size"] else 0)
            for r, f in zip(rows, flows, strict=True)
        ],
        "pattern string, rounds long, rest long",
    )
    bucket = F.shiftright("lot", 60 - BITS)
    by_lot = Window.partitionBy("pattern").orderBy("bucket")
    edge = (
        sized.groupBy("pattern", bucket.alias("bucket"))
        .agg(F.sum("size").alias("in_bucket"))
        .withColumn("upto", F.sum("in_bucket").over(by_lot))
        .join(plan, "pattern")
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("in_bucket") < F.col("rest")))
        .select("pattern", F.col("bucket").alias("edge"), (F.col("rest") - F.col("upto") + F.col("in_bucket")).alias("edge_rest"))
    )
    plan = staged(plan.join(edge, "pattern", "left"), "mix-plan")
    dealt = sized.withColumn("bucket", bucket).join(plan, "pattern", "left")
    inside = dealt.where(F.col("bucket") == F.col("edge"))
    order = Window.partitionBy("pattern").orderBy("lot", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("edge_rest") - ahead)))
    outside = dealt.where(~F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))).withColumn(
        "extra", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0)
    )
    taken = F.coalesce(F.col("rounds"), F.lit(0)) * F.col("size") + F.col("extra")
    result = inside.unionByName(outside).select(
        F.col("doc").alias(id_col), "held", "size", taken.cast("long").alias("taken")
    )
    return result, report


def mix_by_source(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes.

    Null and empty texts have size 0; a null source is a source of its own.
    """
    taken, report = mix(docs, word_count(F.col(text_col)), F.array(F.col(source_col)), **options)
    table = docs.sparkSession.createDataFrame(
        [(s, int(v["size"]), round(float(v["target"]), 6)) for s, v in report.items()],
        T.StructType(
            [
                T.StructField("name", T.StringType()),
                T.StructField("source_size", T.LongType()),
                T.StructField("target", T.DoubleType()),
            ]
        ),
    )
    return (
        taken.withColumn("name", F.get("held", F.lit(0)))
        .join(table.withColumnRenamed("name", "__name"), F.col("name").eqNullSafe(F.col("__name")), "left")
        .drop("__name", "held", "name")
    )
