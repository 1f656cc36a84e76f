"""Clusters around centroids in exact integers.

Vectors are whole numbers, floor(256 x). A round finds each vector's nearest centroid: one matrix
product in single precision gives every squared distance up to an interval that holds the true one,
whatever the order of its additions. Centroids whose interval reaches below the least upper end form the
shortlist; where it has more than one, distances are recomputed in exact integers and the lowest number
wins a tie. Sums of a round are exact as well, so results don't depend on partitions or retries.

Vectors stay in one staged table. Tasks return sums, one row a centroid and task, which Spark adds up;
the driver sees k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.naming import quoted
from tracequarry.session import staged

SCALE = 256
#: A round's sums travel in digits of this many bits, so that they are exact at any size.
DIGIT = 60
LARGEST = 2**63 - 1


def kept_vectors(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(id, v): the vectors of exactly ``width`` components, none of them null or non-finite, as doubles."""
    v = quoted(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(quoted(key).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == width) & whole)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 x): of 64 bits where all fit squares and sums of squares, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if not y.size or np.abs(y).max() <= safe(y.shape[-1]):
        return y.astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 2.0**53 else int(w) for v, w in zip(x.ravel(), y.ravel(), strict=True)]
    return np.array(exact, dtype=object).reshape(x.shape)


def safe(width: int) -> int:
    """The largest absolute component for which a squared distance surely fits 62 bits."""
    return int((2**60 / max(1, width)) ** 0.5)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    d = x - c
    return (d * d).sum(axis=1)


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest: a matrix of vectors by centroids, with at least one true in a row.

    A product of n terms in floating point, added in any order, is off by at most
    n u / (1 - n u) times the product of the norms; u is the unit roundoff. Operands that don't fit the
    precision add one roundoff each. Whole numbers too large for single precision are screened in double
    precision, those beyond it not at all.
    """
    width = x.shape[1]
    if x.dtype != object and c.dtype != object:
        kind, unit = np.float32, 2.0**-24
    else:
        kind, unit = np.float64, 2.0**-53
        if max(map(abs, [*x.ravel(), *c.ravel()]), default=0) > 2**400:
            return np.ones((len(x), len(c)), dtype=bool)
    far, near = x.astype(np.float64), c.astype(np.float64)
    xs, cs = np.sqrt((far * far).sum(axis=1)) * (1 + 1e-9), (near * near).sum(axis=1)
    reach = np.outer(xs, np.sqrt(cs) * (1 + 1e-9))
    product = (x.astype(kind) @ c.astype(kind).T).astype(np.float64)
    share = (width + 4) * unit
    off = 2 * (share / (1 - share)) * reach + (width + 8) * 2.0**-52 * (cs + 2 * reach)
    middle = cs - 2 * product
    return middle - off <= (middle + off).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid, the lowest of equally near ones."""
    may = shortlist(x, c)
    found = may.argmax(axis=1)
    open_rows = np.flatnonzero(may.sum(axis=1) > 1)
    if len(open_rows):
        row, number = np.nonzero(may[open_rows])
        exact = squared(x[open_rows[row]], c[number])
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(exact, starts)
        best = np.flatnonzero(exact == least[row])
        first = best[np.r_[True, row[best][1:] != row[best][:-1]]]
        found[open_rows] = number[first]
    return found


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return whole_numbers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def as_array(centroids: list[list[int]], width: int) -> np.ndarray:
    most = max((abs(v) for c in centroids for v in c), default=0)
    return np.array(centroids, dtype=np.int64 if most <= safe(width) else object)


def digits(value: int) -> list[int]:
    """value = sum of digit * 2 ** (60 place); only the last may be negative."""
    out = []
    while not -(2**DIGIT) < value < 2**DIGIT:
        value, low = value >> DIGIT, value & (2**DIGIT - 1)
        out.append(low)
    return [*out, value]


def moved(vectors: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = as_array(centroids, width)
        sums, counts = np.zeros((k, width), dtype=object), [0] * k
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, width)
                label = nearest(x, c)
                for j in np.unique(label):
                    own = x[label == j]
                    sums[j] = sums[j] + own.sum(axis=0).astype(object)
                    counts[j] += len(own)
        rows = []
        for j in range(k):
            if counts[j]:
                split = [digits(int(v)) for v in sums[j]]
                for place in range(max(map(len, split))):
                    rows.append((j, place, [s[place] if place < len(s) else 0 for s in split]))
                rows.append((j, -1, [counts[j]]))
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, kinds, strict=True)], ["cluster", "place", "sums"])

    parts = vectors.mapInArrow(run, "cluster int, place int, sums array<bigint>")
    each = parts.select("cluster", "place", F.posexplode("sums").alias("dim", "part"))
    total = each.groupBy("cluster", "place", "dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for cluster, place, dim, value in total.collect():  # k times width numbers, times their digits
        if place < 0:
            counts[cluster] = int(value)
        else:
            found[cluster, dim] = found.get((cluster, dim), 0) + (int(value) << (DIGIT * place))
    return [[found[j, d] // counts[j] for d in range(width)] if j in counts else list(c) for j, c in enumerate(centroids)]


def assigned(vectors: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    """(id, cluster, distance): the nearest centroid and the squared distance, at most 2 ** 63 - 1."""
    schema = vectors.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = as_array(centroids, width)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, width)
                label = nearest(x, c)
                d = squared(x, c[label])
                if d.dtype == object:
                    d = np.array([min(int(v), LARGEST) for v in d], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label, pa.int32()), pa.array(d, pa.int64())], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {schema['id'].dataType.simpleString()}, cluster int, distance bigint")


def lot(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", *, width: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    Vectors of another width, null ones, and ones with a null or non-finite component have no row. The
    first centroids are the k vectors whose ``seed:key`` has the least SHA-256; of equal ones (repeated
    or null keys; a null key counts as empty text) the vector least in order. With fewer than k vectors
    there are fewer centroids; equal centroids keep their numbers, and the lower one gets the vectors.
    Repeated rows count each. An empty table gives no rows. Distances and inertias that don't fit 64 bits
    are given as 2 ** 63 - 1; which centroid is nearest is decided exactly at any size. Other columns of
    the table don't take part, whatever their names.
    """
    vectors = staged(kept_vectors(rows, key, vector, width), "cluster-vectors")
    first = vectors.orderBy(lot(F.col("id"), seed), "v").limit(k).select("v").collect()
    centroids = [[int(v) for v in whole_numbers(np.array(r.v, dtype=np.float64))] for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids, width)
    spark = rows.sparkSession
    if not centroids:
        near = vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        near = staged(assigned(vectors, centroids, width), "cluster-assigned")
    sums = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    inertia = min(sum(int(r.s) for r in sums), LARGEST)
    facts = [(r.cluster, min(int(r.s), LARGEST), inertia, digest(centroids[r.cluster])) for r in sums]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return near.join(F.broadcast(told), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
