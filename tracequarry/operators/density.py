"""Density clustering of vectors: a tree of mutual reachability, its condensed clusters, and their choice.

Rules (ours, as the behaviour to match isn't recorded). Likeness is the cosine in millionths, a whole
number, so that equal values are equal everywhere. A vector's core is its likeness to its
``min_samples``-th nearest other; the reach of two vectors is the least of their cores and their likeness.
The maximum spanning tree of reach is found in rounds: every group of vectors takes its best edge to
another group. Going down from the highest reach, groups of at least ``min_size`` vectors are clusters. All
edges of equal reach count at once. A level that joins several clusters makes a new one, their parent; what
is smaller than ``min_size`` when it joins falls to the cluster it joins. With lambda = 1 / distance,
distance = sqrt(2 - 2 cosine) and at least 0.001, a cluster's stability is the sum over its vectors of
lambda where they fall to it (or to a cluster below it, where that begins) less lambda where the cluster
itself is joined. A cluster is chosen if it is at least as stable as all that is chosen below it together;
the one that holds everything never is. Vectors under no chosen cluster are noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators import metric
from tracequarry.operators.graph import components, joined_groups
from tracequarry.session import dropped, staged

MILLION = 1_000_000
#: Edges that one task joins in order, and clusters among which one task chooses.
EDGES_AT_ONCE = 200_000
TREE_AT_ONCE = 200_000


def distance(likeness: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * likeness / MILLION, 1e-6))


def inverse_distance(likeness: Column) -> Column:
    return 1 / F.sqrt(F.greatest(2 - 2 * likeness / MILLION, F.lit(1e-6)))


def reach_tree(vectors: DataFrame, key: str, vector: str, min_samples: int = 5, block: int = metric.BLOCK) -> tuple[DataFrame, DataFrame]:
    """(a, b, reach) of a maximum spanning tree and (id, core) of its nodes.

    Each vector's list of neighbours is twice as long as its core asks for. A group's best edge in the
    lists is its best of all if it is at least what the ends of the lists still allow; for the vectors of
    which that isn't so, blocks are searched for anything better. The largest group needn't ask: the
    others join it. Which of several equal edges is taken decides nothing about clusters.
    """
    k = 2 * max(1, min_samples)
    near = staged(metric.nearest(vectors, vectors, key, vector, k, block).withColumnRenamed(key, "id"), "density-near")
    rows = metric.whole(vectors, key, vector)
    near = near.withColumn("likeness", F.round(F.col("cosine") * MILLION).cast("long"))
    lists = near.groupBy("id").agg(
        F.max(F.when(F.col("rn") == min_samples, F.col("likeness"))).alias("core"),
        F.min("likeness").alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    # with fewer others than the core asks for, the farthest of them stands in; a whole list leaves nothing out
    nodes = rows.join(lists, "id", "left").select(
        "id", F.coalesce("core", "last", F.lit(-MILLION)).alias("core"), F.when(F.col("n") == k, F.col("last")).otherwise(-MILLION - 1).alias("cap"), "v"
    )
    nodes = staged(nodes, "density-nodes")
    cores = nodes.select("id", "core")
    edges = near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "likeness").distinct()
    edges = edges.join(cores.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a").join(cores.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b")
    edges = staged(edges.select("a", "b", F.least("likeness", "ca", "cb").alias("reach")), "density-edges")
    dropped(near)
    labels, tree = nodes.select("id", F.col("id").alias("grp"), "core", "cap"), None
    rounds = []
    searcher = Searcher(nodes, block)
    while True:
        sizes = labels.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        top = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max_by("grp", "n").alias("largest")).head()
        if top["groups"] <= 1:
            break
        out = staged(between(edges, labels), "density-out")
        best = best_of(out)
        open_ = labels.where(F.col("grp") != F.lit(top["largest"])).join(best.select("grp", F.col("best.reach").alias("found")), "grp", "left")
        open_ = open_.where(F.col("found").isNull() | (F.col("cap") > F.col("found")))
        found = searcher.beyond(open_, labels)
        chosen = staged(best_of(out.unionByName(found)).select("best.*").distinct() if found is not None else best.select("best.*").distinct(), "density-chosen")
        grown = chosen.select("a", "b", "reach")
        tree = grown if tree is None else tree.unionByName(grown)
        joined = joined_groups(chosen.select("ga", "gb"), "ga", "gb")
        old = [out, edges, *rounds]
        labels = staged(
            labels.join(joined.withColumnRenamed("node", "grp"), "grp", "left").select("id", F.coalesce("root", "grp").alias("grp"), "core", "cap"), "density-labels"
        )
        # edges within a group are done with
        edges = staged(out.select("a", "b", "reach").unionByName(found.select("a", "b", "reach")) if found is not None else out.select("a", "b", "reach"), "density-edges")
        # a round needs the labels and edges of the one before, and nothing older
        dropped(*old, *([found] if found is not None else []))
        rounds = [labels]
    if tree is None:
        kind = vectors.schema[key].dataType.simpleString()
        tree = vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, reach bigint")
    return tree, cores


def between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends are in different groups, with the groups."""
    own = labels.select("id", "grp")
    ends = edges.join(own.select(F.col("id").alias("a"), F.col("grp").alias("ga")), "a").join(own.select(F.col("id").alias("b"), F.col("grp").alias("gb")), "b")
    return ends.where(F.col("ga") != F.col("gb")).select("a", "b", "reach", "ga", "gb")


def best_of(out: DataFrame) -> DataFrame:
    """(grp, best): each group's edge of the highest reach, of equal ones the least in order."""
    edge = F.struct((-F.col("reach")).alias("minus"), "a", "b", "reach", "ga", "gb")
    both = out.select(F.col("ga").alias("grp"), edge.alias("e")).unionByName(out.select(F.col("gb").alias("grp"), edge.alias("e")))
    return both.groupBy("grp").agg(F.min("e").alias("best"))


class Searcher:
    """Finds each vector's best edge out of its group, by the bounds of ``metric``."""

    def __init__(self, nodes: DataFrame, block: int) -> None:
        self.nodes, self.block = nodes, block
        self.count = nodes.count()
        self.kind = nodes.schema["id"].dataType.simpleString()
        self.blocks = None

    def prepare(self) -> None:
        if self.blocks is None:
            self.pivots = metric.pivots_of(self.nodes, self.count, self.block)
            self.blocks = metric.blocks_of(self.nodes.select("id", "v"), self.pivots, self.count, self.block)
            self.cells = metric.cells_of(self.blocks, self.pivots)

    def with_labels(self, blocks: DataFrame, labels: DataFrame) -> DataFrame:
        """Blocks with the groups and cores of their vectors, in the order of their ids."""
        each = blocks.select("b", F.explode("ids").alias("id")).join(labels.select("id", "grp", "core"), "id")
        own = each.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("id", "grp", "core"))).alias("s"))
        return blocks.join(own, "b").select(*blocks.columns, F.col("s.grp").alias("grps"), F.col("s.core").alias("cores"))

    def beyond(self, open_: DataFrame, labels: DataFrame) -> DataFrame | None:
        """(a, b, reach, ga, gb) better than ``found`` out of the groups of the vectors in ``open_``; None without any."""
        asked = staged(open_.select("id", "found").join(self.nodes.select("id", "v"), "id"), "density-open")
        n = asked.count()
        if not n:
            return None
        self.prepare()
        kind, cells = self.kind, asked.sparkSession.sparkContext.broadcast(self.cells)
        mine = dealt = metric.blocks_of(asked.select("id", "v"), self.pivots, n, self.block)
        limits = mine.select("b", F.explode("ids").alias("id")).join(asked.select("id", "found"), "id")
        limits = limits.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("found", F.lit(-2 * MILLION)).alias("found")))).alias("s"))
        mine = self.with_labels(mine, labels).join(limits.select("b", F.col("s.found").alias("found")), "b")

        def reach_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = cells.value
            for pdf in batches:
                taus, most, where = [], [], []
                for r in pdf.itertuples():
                    x = metric.matrix(r.data, len(r.ids), r.width)
                    found = np.array(r.found)
                    tau = np.where(found < -MILLION, np.inf, np.sqrt(np.maximum(0, 2 - 2 * found / MILLION) + metric.SLACK))
                    tau[~x.any(axis=1)] = np.inf
                    taus.append(tau.tobytes())
                    most.append(tau.max())
                    d = metric.distances(metric.placed(x), c.pivots)
                    where.append(np.flatnonzero((d - c.reach <= tau[:, None] + metric.SLACK).any(axis=0)).astype(np.int32).tolist())
                yield pdf.assign(tau=taus, most=most, cells=where)

        columns = f"cell int, size int, far double, ids array<{kind}>, width int, data binary, middle array<double>, radius double, b bigint, grps array<{kind}>, cores array<bigint>"
        left = staged(mine.select(*[c.split(" ")[0] for c in columns.split(", ")], "found").mapInPandas(reach_of, columns + ", found array<bigint>, tau binary, most double, cells array<int>"), "density-asking")
        right = staged(self.with_labels(self.blocks, labels), "density-blocks")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    ids, other = np.array(r.ids), np.array(r.o_ids)
                    x, y = metric.matrix(r.data, len(ids), r.width), metric.matrix(r.o_data, len(other), r.o_width)
                    groups, theirs, cores, found = np.array(r.grps), np.array(r.o_grps), np.array(r.cores), np.array(r.found)
                    for part in metric.slices(metric.taking_part(x, np.frombuffer(r.tau), r.o_middle, r.o_radius)):
                        own = groups[part]
                        reach = np.rint(np.round(x[part] @ y.T, 6) * MILLION)
                        reach = np.minimum(np.minimum(reach, cores[part][:, None]), np.array(r.o_cores)[None])
                        reach[own[:, None] == theirs[None]] = -np.inf
                        at = reach.argmax(axis=1)
                        best = reach[np.arange(len(part)), at]
                        good = best > found[part]
                        u, w = ids[part][good], other[at[good]]
                        gu, gw = own[good], theirs[at[good]]
                        first = u < w
                        yield pd.DataFrame({
                            "a": np.where(first, u, w), "b": np.where(first, w, u), "reach": best[good].astype(np.int64),
                            "ga": np.where(first, gu, gw), "gb": np.where(first, gw, gu),
                        })

        edges = f"a {kind}, b {kind}, reach bigint, ga {kind}, gb {kind}"
        found = metric.met(left, right, self.count, run, edges, ("grps", "cores", "found"))
        # one edge a group and search: the best
        by = F.struct((-F.col("reach")).alias("minus"), "a", "b", "reach", "ga", "gb")
        groups = open_.select("grp").distinct()
        each = found.select(F.col("ga").alias("grp"), by.alias("e")).unionByName(found.select(F.col("gb").alias("grp"), by.alias("e"))).join(groups, "grp", "left_semi")
        made = staged(each.groupBy("grp").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.reach", "e.ga", "e.gb").distinct(), "density-found")
        dropped(asked, dealt, left, right)
        return made


def level_ranges(tree: DataFrame, most: int) -> list[tuple[int, int, int]]:
    """(highest, lowest, edges) of ranges of levels with at most ``most`` edges, or one level with more, from the top.

    What is gathered is one row for each 1/1,000 of likeness, and one for each level of a part that is too full.
    """
    fine = [(r.level, r.n) for r in tree.groupBy(F.floor(F.col("reach") / 1000).alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()]
    steps = []
    for part, n in fine:
        low = part * 1000
        if n <= most:
            steps.append((low + 999, low, n))
        else:
            rows = tree.where(F.col("reach").between(low, low + 999)).groupBy("reach").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("reach")).collect()
            steps += [(r.reach, r.reach, r.n) for r in rows]
    out: list[tuple[int, int, int]] = []
    for high, low, n in steps:
        if out and out[-1][2] + n <= most:
            out[-1] = (out[-1][0], low, out[-1][2] + n)
        else:
            out.append((high, low, n))
    return out


def condensed(tree: DataFrame, nodes: DataFrame, min_size: int = 5, most: int = EDGES_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, at) of vectors and (cluster, parent, size, at) of clusters, from the top level down.

    ``at`` is the level at which a vector falls to its cluster, or at which a cluster is joined to
    others under its parent; the cluster of the last level has neither parent nor level. A cluster's name
    is level:least id of its group. Levels are taken in ranges of at most ``most`` edges, each range in one
    task over the groups that the ranges before it have made; a single level with more edges is taken by
    joins. Vectors that never meet ``min_size`` others have no row.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    labels = nodes.select("id", F.col("id").alias("grp"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("string").alias("home"), F.lit(None).cast("long").alias("at"))
    clusters = None
    for high, low, n in level_ranges(tree, most):
        groups = labels.select("grp", "size", "cluster").distinct()
        ends = tree.where(F.col("reach").between(low, high))
        a, b = (groups.select(*(F.col(c).alias(f"{c}_{s}") for c in groups.columns)) for s in "ab")
        own = labels.select("id", "grp")
        ends = ends.join(own.select(F.col("id").alias("a"), F.col("grp").alias("grp_a")), "a").join(own.select(F.col("id").alias("b"), F.col("grp").alias("grp_b")), "b")
        ends = ends.join(a, "grp_a").join(b, "grp_b").select("reach", "grp_a", "size_a", "cluster_a", "grp_b", "size_b", "cluster_b")
        if n <= most:
            step = ends.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
                lambda pdf: in_order(pdf, min_size), f"grp {kind}, new {kind}, size bigint, cluster string, home string, at bigint, born string, parent string, born_size bigint, born_at bigint"
            )
        else:
            step = at_one_level(ends, low, min_size, kind)
        step = staged(step, "density-step")
        made = step.where("born is not null").select(F.col("born").alias("cluster"), "parent", F.col("born_size").alias("size"), F.col("born_at").alias("at"))
        clusters = made if clusters is None else clusters.unionByName(made)
        moved = step.where("new is not null").select("grp", F.col("new").alias("n_grp"), F.col("size").alias("n_size"), F.col("cluster").alias("n_cluster"), F.col("home").alias("n_home"), F.col("at").alias("n_at"))
        met = labels.join(moved, "grp", "left")
        labels = staged(
            met.select(
                "id", F.coalesce("n_grp", "grp").alias("grp"), F.coalesce("n_size", "size").alias("size"), F.coalesce("n_cluster", "cluster").alias("cluster"),
                F.coalesce("home", "n_home").alias("home"), F.coalesce("at", "n_at").alias("at"),
            ),
            "density-labels",
        )
    last = labels.where("cluster is not null").groupBy("cluster").agg(F.max("size").alias("size"))
    roots = last.select("cluster", F.lit(None).cast("string").alias("parent"), "size", F.lit(None).cast("long").alias("at"))
    clusters = roots if clusters is None else roots.unionByName(clusters)
    return labels.where("home is not null").select("id", F.col("home").alias("cluster"), "at"), staged(clusters, "density-tree")


def in_order(pdf: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """The groups of a range of levels joined from its top down, all edges of a level at once.

    Rows: groups with what becomes of them (new, size, cluster, and home and at for what was too small
    when it came to a cluster), and clusters that got a parent (born, parent, born_size, born_at).
    """
    size, cluster, up, members, fallen, joined = {}, {}, {}, {}, {}, []
    for s in "ab":
        for g, n, c in zip(pdf[f"grp_{s}"].tolist(), pdf[f"size_{s}"].tolist(), pdf[f"cluster_{s}"].tolist(), strict=True):
            size[g], cluster[g], up[g] = n, c if isinstance(c, str) else None, g
            members[g] = [] if isinstance(c, str) else [g]

    def root(g):
        while up[g] != g:
            up[g] = up[up[g]]
            g = up[g]
        return g

    for level, edges in sorted(pdf.groupby("reach"), reverse=True, key=lambda x: x[0]):
        touched: dict = {}
        for x, y in zip(edges["grp_a"].tolist(), edges["grp_b"].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                low, high = (x, y) if x < y else (y, x)
                up[high] = low
                touched.setdefault(low, [low]).extend(touched.pop(high, [high]))
        for top, parts in touched.items():
            total = sum(size[p] for p in parts)
            held = [(cluster[p], size[p]) for p in parts if cluster[p] is not None]
            small = [g for p in parts if cluster[p] is None for g in members[p]]
            name = held[0][0] if len(held) == 1 else f"{level}:{top}" if total >= min_size else None
            if len(held) > 1:
                joined += [(c, name, n, int(level)) for c, n in held]
            if name is not None:
                fallen |= dict.fromkeys(small, (name, int(level)))
                small = []
            size[top], cluster[top], members[top] = total, name, small
    rows = []
    for g in up:
        top, (home, at) = root(g), fallen.get(g, (None, None))
        rows.append((g, top, size[top], cluster[top], home, at, None, None, None, None))
    rows += [(None, None, None, None, None, None, *j) for j in joined]
    out = pd.DataFrame(rows, columns=["grp", "new", "size", "cluster", "home", "at", "born", "parent", "born_size", "born_at"], dtype=object)
    return out.astype({c: "Int64" for c in ("size", "at", "born_size", "born_at")})


def at_one_level(ends: DataFrame, level: int, min_size: int, kind: str) -> DataFrame:
    """What ``in_order`` gives, for one level with any number of edges."""
    ends = staged(ends, "density-level")
    new = components(ends.select("grp_a", "grp_b"), "grp_a", "grp_b").select(F.col("node").alias("grp"), F.col("root").alias("new"))
    groups = ends.select(F.col("grp_a").alias("grp"), F.col("size_a").alias("size"), F.col("cluster_a").alias("cluster")).unionByName(
        ends.select(F.col("grp_b").alias("grp"), F.col("size_b").alias("size"), F.col("cluster_b").alias("cluster"))
    )
    groups = staged(groups.distinct().join(new, "grp"), "density-level")
    whole = groups.groupBy("new").agg(F.sum("size").alias("total"), F.count("cluster").alias("held"), F.max("cluster").alias("only"))
    name = F.when(F.col("held") == 1, F.col("only")).when(F.col("total") >= min_size, F.concat(F.lit(f"{level}:"), F.col("new").cast("string")))
    met = groups.join(whole.withColumn("name", name), "new")
    falls = F.col("cluster").isNull() & F.col("name").isNotNull()
    none = {c: F.lit(None).cast(t) for c, t in {"born": "string", "parent": "string", "born_size": "long", "born_at": "long"}.items()}
    kept = met.select("grp", "new", F.col("total").alias("size"), F.col("name").alias("cluster"), F.when(falls, F.col("name")).alias("home"), F.when(falls, F.lit(level)).cast("long").alias("at"), *(v.alias(c) for c, v in none.items()))
    born = met.where((F.col("held") > 1) & F.col("cluster").isNotNull()).select(
        F.lit(None).cast(kind).alias("grp"), F.lit(None).cast(kind).alias("new"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("string").alias("home"), F.lit(None).cast("long").alias("at"),
        F.col("cluster").alias("born"), F.col("name").alias("parent"), F.col("size").alias("born_size"), F.lit(level).cast("long").alias("born_at"),
    )
    return kept.unionByName(born)


def stabilities(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, parent, size, at, stability); the last level counts from lambda 0."""
    own = points.groupBy("cluster").agg(F.sum(inverse_distance(F.col("at"))).alias("sum"), F.count(F.lit(1)).alias("n"))
    below = clusters.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.col("size") * inverse_distance(F.col("at"))).alias("sum"), F.sum("size").alias("n"))
    total = own.unionByName(below).groupBy("cluster").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    base = F.coalesce(inverse_distance(F.col("at")), F.lit(0.0))
    return clusters.join(total, "cluster", "left").select("cluster", "parent", "size", "at", F.round(F.coalesce("sum", F.lit(0.0)) - F.coalesce("n", F.lit(0)) * base, 6).alias("stability"))


def choose(tree: DataFrame, at_once: int = TREE_AT_ONCE) -> DataFrame:
    """(cluster, picked): whether a cluster is at least as stable as the best below it together; never the root.

    Clusters without undecided ones below are decided in rounds until ``at_once`` are left, which one
    task decides.
    """
    left = staged(tree.select("cluster", "parent", "stability", F.lit(0.0).alias("below")), "density-left")
    done = None
    while left.count() > at_once:
        inner = left.select(F.col("parent").alias("cluster")).where("cluster is not null").distinct()
        leaves = staged(left.join(inner, "cluster", "left_anti").withColumn("best", F.greatest("stability", "below")), "density-leaves")
        decided = leaves.select("cluster", (F.col("parent").isNotNull() & (F.col("stability") >= F.col("below"))).alias("picked"))
        done = decided if done is None else done.unionByName(decided)
        more = leaves.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("more"))
        rest = left.join(leaves.select("cluster"), "cluster", "left_anti").join(more, "cluster", "left")
        left = staged(rest.select("cluster", "parent", "stability", (F.col("below") + F.coalesce("more", F.lit(0.0))).alias("below")), "density-left")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = {c: p if isinstance(p, str) else None for c, p in zip(pdf["cluster"], pdf["parent"], strict=True)}
        own, below = dict(zip(pdf["cluster"], pdf["stability"], strict=True)), dict(zip(pdf["cluster"], pdf["below"], strict=True))
        open_ = dict.fromkeys(parent, 0)
        for p in parent.values():
            if p is not None:
                open_[p] += 1
        ready, picked = sorted(c for c, n in open_.items() if not n), {}
        while ready:
            c = ready.pop()
            picked[c] = parent[c] is not None and own[c] >= below[c]
            p = parent[c]
            if p is not None:
                below[p] = round(below[p] + max(own[c], below[c]), 6)
                open_[p] -= 1
                if not open_[p]:
                    ready.append(p)
        return pd.DataFrame({"cluster": list(picked), "picked": list(picked.values())})

    last = left.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: decide(pdf), "cluster string, picked boolean")
    return last if done is None else done.unionByName(last)


def highest_picked(tree: DataFrame) -> DataFrame:
    """(cluster, top): the picked cluster nearest to the root on each cluster's way up, in doubling steps."""
    now = staged(tree.select("cluster", F.col("parent").alias("up"), F.when(F.col("picked"), F.col("cluster")).alias("top")), "density-up")
    while now.where("up is not null").head(1):
        above = now.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("top").alias("higher"))
        now = staged(now.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top")), "density-up")
    return now.select("cluster", "top")


def density_groups(vectors: DataFrame, key: str, vector: str, min_size: int = 5, min_samples: int = 5, block: int = metric.BLOCK, edges_at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(key, grp, reach): each vector's cluster, named by its least vector, null for noise, and the level at which it falls to a cluster.

    Keys are unique and not null; null vectors and those with a null component have no row. A table
    of fewer than ``min_size`` vectors, or one whose clusters never part, is all noise. Equal vectors are
    always together.
    """
    tree, nodes = reach_tree(vectors, key, vector, min_samples, block)
    points, clusters = condensed(tree, nodes, min_size, edges_at_once)
    scored = staged(stabilities(points, clusters), "density-scored")
    tops = highest_picked(scored.join(choose(scored), "cluster"))
    found = nodes.select("id").join(points, "id", "left").join(tops, "cluster", "left").select("id", "top", F.col("at").alias("reach"))
    found = staged(found, "density-found")
    names = found.where("top is not null").groupBy("top").agg(F.min("id").alias("grp"))
    return found.join(names, "top", "left").select(F.col("id").alias(key), "grp", "reach")
