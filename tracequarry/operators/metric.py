"""Exact nearest neighbours without all pairs: cells around pivots and the triangle inequality.

Unit vectors are dealt to the nearest of at most 1,024 pivots, and a cell is cut, by distance from its
pivot, into blocks of bounded size, so a cell that holds most vectors has many blocks. Each block knows
its middle and its radius. A vector's k-th neighbour is at most as far as the k-th within its own block,
or as the far end of any cell that holds enough vectors; blocks meet only if, by the triangle inequality,
a vector of one can lie that near to a vector of the other. Inside a meeting only the rows that can gain
from it take part; products are made in single precision, and what may be near enough, their error
allowed for, is computed again in double precision.

How much that saves is a matter of the data: vectors in groups or of few dimensions meet few blocks,
while random ones of many dimensions are all about equally far from each other, and meet most. Blocks meet in
a nested loop over the files of the two sides, so no matrix is written again for the blocks that it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.session import staged

BLOCK = 8192
PIVOTS = 1024
#: Rows of a block that are compared at once.
SLICE = 1024
#: Vectors that a block meets in one task, which holds them.
AT_ONCE = 262_144
#: Squared distances may be off by this much: cosines are rounded to six decimals.
SLACK = 1e-5


def units(rows: pd.Series) -> np.ndarray:
    """Rows as unit vectors of doubles; a vector of zeros stays."""
    x = np.array(rows.tolist(), dtype=np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix(data: bytes, count: int, width: int) -> np.ndarray:
    """The unit vectors of a block, which holds them as they came, in single or double precision."""
    kind = np.float32 if len(data) == 4 * count * width else np.float64
    x = np.frombuffer(data, dtype=kind).reshape(count, width).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def error(width: int) -> float:
    """How far a product of unit vectors in single precision may be off."""
    return (width + 4) * 2.0**-23


def slices(rows: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(rows), SLICE):
        yield rows[at : at + SLICE]


def placed(x: np.ndarray) -> np.ndarray:
    """Points for the bounds: a vector of zeros, whose cosines are all 0, gets a dimension of its own."""
    return np.hstack([x, (~x.any(axis=1)).astype(np.float64)[:, None]])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0))


@dataclass
class Cells:
    """What all tasks know of a table: its pivots and, for each, the farthest of its vectors and their number."""

    pivots: np.ndarray
    reach: np.ndarray
    size: np.ndarray


def pivots_of(vectors: DataFrame, count: int, block: int = BLOCK) -> np.ndarray:
    """At most 1,024 points, two for each block that the table fills: of four times as many, taken by hash, those that lie far apart."""
    n = min(PIVOTS, max(1, -(-2 * count // block)))
    rows = vectors.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(4 * n).select("v").toPandas()
    if not len(rows):
        return np.zeros((0, 1))
    points = placed(units(rows["v"]))
    chosen = [0]
    apart = distances(points, points[:1])[:, 0]
    while len(chosen) < n and apart.max() > 1e-6:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def blocks_of(vectors: DataFrame, pivots: np.ndarray, count: int, block: int = BLOCK) -> DataFrame:
    """(b, cell, size, far, ids, width, data, middle, radius): blocks of one cell each, ids ascending.

    Takes (id, v). ``data`` is the vectors as they came, of single or double precision, ``far`` the largest
    distance from the pivot.
    """
    kind, own = (vectors.schema[c].dataType.simpleString() for c in ("id", "v"))
    stored = np.float32 if own == "array<float>" else np.float64

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(placed(units(pdf["v"])), pivots)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": cell.astype(np.int32), "r": d[np.arange(len(d)), cell]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, own in pdf.groupby("cell"):
                for rows in np.array_split(np.arange(len(own)), -(-len(own) // block)):
                    part = own.iloc[rows].sort_values("id")
                    raw = np.array(part["v"].tolist(), dtype=stored)
                    points = placed(units(part["v"]))
                    middle = points.mean(axis=0)
                    radius = distances(points, middle[None]).max()
                    yield pd.DataFrame({
                        "cell": [int(cell)], "size": [len(part)], "far": [part["r"].max()], "ids": [part["id"].tolist()],
                        "width": [raw.shape[1]], "data": [raw.tobytes()], "middle": [middle], "radius": [radius],
                    })

    dealt = vectors.mapInPandas(deal, f"id {kind}, v {own}, cell int, r double")
    runs = dealt.repartitionByRange(max(1, -(-count // block)), "cell", "r", "id").sortWithinPartitions("cell", "r", "id")
    packed = runs.mapInPandas(pack, f"cell int, size int, far double, ids array<{kind}>, width int, data binary, middle array<double>, radius double")
    return staged(packed.withColumn("b", F.monotonically_increasing_id()), "metric-blocks")


def cells_of(blocks: DataFrame, pivots: np.ndarray) -> Cells:
    found = blocks.groupBy("cell").agg(F.max("far").alias("far"), F.sum("size").alias("size")).collect()  # at most 1,024 rows
    reach, size = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    for r in found:
        reach[r["cell"]], size[r["cell"]] = r["far"], r["size"]
    return Cells(pivots, reach, size)


def asking(blocks: DataFrame, cells: Cells, k: int, same: bool) -> DataFrame:
    """Blocks with ``tau``, the distance within which each vector's k nearest lie, ``most``, the largest, and the cells to look in."""
    known = blocks.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = known.value
        for pdf in batches:
            taus, most, where = [], [], []
            for r in pdf.itertuples():
                x = matrix(r.data, len(r.ids), r.width)
                d = distances(placed(x), c.pivots)
                far = np.where(c.size >= k + 1, d + c.reach, np.inf).min(axis=1)
                if same and len(x) > k:
                    single = x.astype(np.float32)
                    for rows in slices(np.arange(len(x))):
                        near = single[rows] @ single.T
                        near[np.arange(len(rows)), rows] = -np.inf
                        kth = np.partition(near, -k, axis=1)[:, -k].astype(np.float64) - error(r.width)
                        far[rows] = np.minimum(far[rows], np.sqrt(np.maximum(0, 2 - 2 * kth)))
                tau = np.sqrt(far * far + SLACK)
                tau[~x.any(axis=1)] = np.inf
                taus.append(tau.tobytes())
                most.append(tau.max())
                where.append(np.flatnonzero((d - c.reach <= tau[:, None] + SLACK).any(axis=0)).astype(np.int32).tolist())
            yield pdf.assign(tau=taus, most=most, cells=where)

    kind = blocks.schema["ids"].dataType.simpleString()
    out = f"cell int, size int, far double, ids {kind}, width int, data binary, middle array<double>, radius double, b bigint, tau binary, most double, cells array<int>"
    return blocks.mapInPandas(run, out)


def meeting() -> Column:
    """Whether some vector of a block can gain from another one, whose columns have ``o_`` in front."""
    squares = F.zip_with("middle", "o_middle", lambda x, y: (x - y) * (x - y))
    apart = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)) - F.col("radius") - F.col("o_radius")
    return F.array_contains("cells", F.col("o_cell")) & (apart <= F.col("most") + SLACK)


def meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): blocks of ``left`` and the blocks of ``right`` that some of its vectors can gain from."""
    others = right.select("b", *(F.col(c).alias(f"o_{c}") for c in ("cell", "middle", "radius")))
    return left.select(F.col("b").alias("a"), "cells", "middle", "radius", "most").join(others, meeting()).select("a", "b")


def met(left: DataFrame, right: DataFrame, count: int, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], out: str, more: Sequence[str] = ()) -> DataFrame:
    """Runs ``run`` over rows that hold a block of ``left`` (as a) and, with ``o_`` in front, one of ``right``, which has ``count`` vectors.

    Each task reads some files of the left and a part of the right of about ``AT_ONCE`` vectors; the meetings of
    a block with such a part come in a row. Both sides are tables of files, which are read again by each task.
    """
    others = right.coalesce(max(1, -(-count // AT_ONCE))).select("b", *(F.col(c).alias(f"o_{c}") for c in right.columns if c not in ("b", "far", "size")))
    pairs = left.withColumnRenamed("b", "a").join(others.hint("shuffle_replicate_nl"), meeting())
    theirs = [c for c in others.columns if c != "o_cell"]
    return pairs.select("a", "ids", "width", "data", "tau", *more, *theirs).mapInPandas(run, out)


def taking_part(x: np.ndarray, tau: np.ndarray, middle: np.ndarray, radius: float) -> np.ndarray:
    """Rows that may have something within ``tau`` in a block of this middle and radius."""
    apart = distances(placed(x), middle[None])[:, 0] - radius
    return np.flatnonzero(apart <= tau + SLACK)


class Best:
    """The k nearest so far of each vector of a block, while it meets one block after the other."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, tau: np.ndarray, k: int) -> None:
        self.x, self.single, self.ids, self.tau, self.k = x, x.astype(np.float32), ids, tau.copy(), k
        self.row, self.other, self.cosine = np.zeros(0, dtype=np.int64), ids[:0], np.zeros(0)

    def meet(self, y: np.ndarray, others: np.ndarray, middle: np.ndarray, radius: float) -> None:
        width, single = y.shape[1], y.astype(np.float32).T
        rows, found, cosines = [self.row], [self.other], [self.cosine]
        for part in slices(taking_part(self.x, self.tau, middle, radius)):
            least = 1 - self.tau[part] ** 2 / 2 - SLACK - error(width)
            row, col = np.nonzero(self.single[part] @ single >= least[:, None])
            row = part[row]
            own = self.ids[row] != others[col]
            row, col = row[own], col[own]
            for at in range(0, len(row), 1 << 18):
                r, c = row[at : at + (1 << 18)], col[at : at + (1 << 18)]
                cosine = np.round((self.x[r] * y[c]).sum(axis=1), 6)
                keep = top(r, others[c], cosine, self.k)
                rows.append(r[keep])
                found.append(others[c][keep])
                cosines.append(cosine[keep])
        row, other, cosine = np.concatenate(rows), np.concatenate(found), np.concatenate(cosines)
        keep = top(row, other, cosine, self.k)
        self.row, self.other, self.cosine = row[keep], other[keep], cosine[keep]
        # a vector with k of them needs none that is farther than the last
        last = np.flatnonzero(np.r_[self.row[1:] != self.row[:-1], True]) if len(self.row) else np.zeros(0, dtype=np.int64)
        full = last[np.bincount(self.row, minlength=len(self.x))[self.row[last]] >= self.k]
        self.tau[self.row[full]] = np.minimum(self.tau[self.row[full]], np.sqrt(np.maximum(0, 2 - 2 * self.cosine[full]) + SLACK))

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"id": self.ids[self.row], "neighbour": self.other, "cosine": self.cosine})


def top(row: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of the k entries of each row with the highest cosine, ties by the other's id; sorted so."""
    order = np.lexsort((other, -cosine, row))
    ordered = row[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[place < k]


def nearest(vectors: DataFrame, others: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(key, neighbour, cosine, rn): the k of ``others`` most alike to each vector but itself, exactly.

    Cosines have six decimals, ties go to the least neighbour. Null vectors and those with a null
    component take no part; a vector of zeros has cosine 0 with all.
    """
    same = vectors is others
    kind = vectors.schema[key].dataType.simpleString()
    found = f"id {kind}, neighbour {kind}, cosine double"
    tables = [whole(x, key, vector) for x in ([vectors] if same else [vectors, others])]
    counts = [t.count() for t in tables]
    if not min(counts):
        return vectors.sparkSession.createDataFrame([], found + ", rn int").withColumnRenamed("id", key)
    pivots = pivots_of(tables[-1], counts[-1], block)
    sides = [blocks_of(t, pivots, n, block) for t, n in zip(tables, counts, strict=True)]
    left, right = sides[0], sides[-1]
    asked = staged(asking(left, cells_of(right, pivots), k, same), "metric-asking")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best = None, None
        for pdf in batches:
            for r in pdf.itertuples():
                if r.a != now:
                    if best is not None:
                        yield best.found()
                    now, best = r.a, Best(matrix(r.data, len(r.ids), r.width), np.array(r.ids), np.frombuffer(r.tau), k)
                best.meet(matrix(r.o_data, len(r.o_ids), r.o_width), np.array(r.o_ids), r.o_middle, r.o_radius)
        if best is not None:
            yield best.found()

    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return met(asked, right, counts[-1], run, found).withColumn("rn", rank).where(F.col("rn") <= k).withColumnRenamed("id", key)


def whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    v = v if vectors.schema[vector].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    return vectors.select(F.col(key).alias("id"), v.alias("v")).where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()))


def share_met(vectors: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> tuple[int, int]:
    """(pairs of blocks that ``nearest`` compares, all pairs of blocks) of a table with itself."""
    rows = whole(vectors, key, vector)
    n = rows.count()
    pivots = pivots_of(rows, n, block)
    blocks = blocks_of(rows, pivots, n, block)
    asked = staged(asking(blocks, cells_of(blocks, pivots), k, True), "metric-asking")
    return meetings(asked, blocks).count(), blocks.count() ** 2
