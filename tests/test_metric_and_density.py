import math
import random
from collections import Counter

import numpy as np
import pytest

from tracequarry.operators import density, embed, metric


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, v array<double>, cell string")


def brute_nearest(left, right, k):
    out = set()
    for i, v in left:
        if v is None or None in v:
            continue
        found = []
        for j, w in right:
            if j != i and w is not None and None not in w:
                n = math.hypot(*v) * math.hypot(*w)
                found.append((-round(sum(a * b for a, b in zip(v, w, strict=True)) / n, 6) if n else 0.0, j))
        out |= {(i, j, rn) for rn, (_, j) in enumerate(sorted(found)[:k], 1)}
    return out


def grouped(n, groups, width, seed, spread=0.05):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, spread) for x in middles[i % groups]]) for i in range(n)]


@pytest.mark.parametrize("block", [3, 16, 1024])
def test_neighbours_of_odd_rows(spark, block):
    rows = grouped(90, 6, 4, 1) + [(200 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(12)]
    rows += [(300, [0.0] * 4), (301, [0.0] * 4), (302, None), (303, [1.0, None, 0.0, 0.0])]
    got = {(r["id"], r["neighbour"], r["rn"]) for r in embed.top_neighbours(table(spark, rows), "id", "v", 4, block).collect()}
    assert got == brute_nearest(rows, rows, 4)


def test_neighbours_in_another_table(spark):
    left, right = grouped(40, 5, 3, 2), [(1000 + i, v) for i, v in grouped(70, 5, 3, 2)]
    got = {(r["id"], r["neighbour"], r["rn"]) for r in metric.nearest(table(spark, left), table(spark, right), "id", "v", 3, 8).collect()}
    assert got == brute_nearest(left, right, 3)
    assert metric.nearest(table(spark, left), table(spark, []), "id", "v", 3).count() == 0


def test_few_vectors_have_few_neighbours(spark):
    rows = grouped(3, 1, 2, 3)
    assert embed.top_neighbours(table(spark, rows), "id", "v", 8).count() == 6


def test_grouped_vectors_meet_few_blocks_and_hot_cells_have_many(spark):
    small, large = (metric.share_met(table(spark, grouped(n, n // 64, 16, 4)), "id", "v", 4, 32) for n in (1_000, 8_000))
    assert large[0] < 0.15 * large[1]
    assert large[0] < 16 * small[0]  # 64 times the pairs
    one = [(i, [1.0, 0.001 * (i % 7)]) for i in range(2_000)]
    met, pairs = metric.share_met(table(spark, one), "id", "v", 2, 64)
    assert pairs >= 900 and met <= pairs


def brute_density(rows, m, samples):
    """Clusters from the whole vector set downwards, level by level."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = np.rint(np.round(x @ x.T, 6) * 1e6).astype(int)
    others = [sorted((like[a, b] for b in range(len(ids)) if b != a), reverse=True) for a in range(len(ids))]
    core = [o[min(samples, len(o)) - 1] if o else -(10**6) for o in others]
    reach = {(a, b): min(like[a, b], core[a], core[b]) for a in range(len(ids)) for b in range(a)}
    levels = sorted(set(reach.values()))

    def parts(points, level):
        left, out = set(points), []
        while left:
            stack = [left.pop()]
            part = set(stack)
            while stack:
                a = stack.pop()
                new = {b for b in left if reach[max(a, b), min(a, b)] >= level}
                left -= new
                part |= new
                stack += new
            out.append(part)
        return out

    lam = lambda s: 1 / max(math.sqrt(max(2 - 2 * s / 1e6, 0)), 1e-3)

    def cluster(points, birth):
        """(stability, its points' levels, children)."""
        base, at, now, before = 0 if birth is None else lam(birth), {}, set(points), birth
        for level in levels:
            if birth is not None and level <= birth:
                continue
            split = parts(now, level)
            large = [p for p in split if len(p) >= m]
            for p in split:
                if len(p) < m:
                    at |= dict.fromkeys(p, before)
            if len(large) != 1:
                break
            now, before = large[0], level
        else:
            large, at = [], at | dict.fromkeys(now, before)
        children = [cluster(p, before) for p in large]
        own = sum(lam(s) - base for s in at.values()) + sum(len(p) * (lam(before) - base) for p in large)
        return round(own, 6), at, children, set(points)

    found = {}

    def best(c, root):
        own, at, children, points = c
        below = [best(x, False) for x in children]
        total = round(sum(b for b, _ in below), 6)
        if not root and own >= total - 1e-9:
            return max(own, total), [points]
        return (max(own, total) if not root else total), [p for _, ps in below for p in ps]

    if len(ids) >= m:
        top = cluster(range(len(ids)), None)
        for points in best(top, True)[1]:
            for p in points:
                found[ids[p]] = min(ids[q] for q in points)
        levels_of = {}

        def walk(c):
            levels_of.update({ids[p]: s for p, s in c[1].items()})
            for x in c[2]:
                walk(x)

        walk(top)
    else:
        levels_of = {}
    return {i: (found.get(i), levels_of.get(i)) for i in ids}, Counter(spanning(reach, len(ids)))


def spanning(reach, n):
    up = list(range(n))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    out = []
    for (a, b), s in sorted(reach.items(), key=lambda x: -x[1]):
        a, b = root(a), root(b)
        if a != b:
            up[a] = b
            out.append(s)
    return out


def loose(n, groups, width, seed):
    rng = random.Random(seed)
    rows = grouped(n - n // 4, groups, width, seed, 0.25)
    return rows + [(1000 + i, [rng.gauss(0, 1) for _ in range(width)]) for i in range(n // 4)]


@pytest.mark.parametrize(("seed", "most"), [(1, 200_000), (2, 12)])
def test_density_against_brute_force(spark, seed, most):
    rows = loose(60, 3, 3, seed) + [(2000 + i, [0.6, 0.8, 0.0]) for i in range(14)]
    want, weights = brute_density(rows, 5, 4)
    tree, _ = density.reach_tree(table(spark, rows), "id", "v", 4, block=16)
    assert Counter(r.reach for r in tree.collect()) == weights
    got = density.density_groups(table(spark, rows), "id", "v", 5, 4, block=16, edges_at_once=most)
    assert {r["id"]: (r["grp"], r["reach"]) for r in got.collect()} == want
    assert len({g for g, _ in want.values()}) > 2


def test_density_of_few_or_no_vectors(spark):
    assert density.density_groups(table(spark, []), "id", "v").count() == 0
    for n in (4,):
        got = density.density_groups(table(spark, loose(n, 1, 3, 1)), "id", "v", 5, 3).collect()
        assert len(got) == n and all(r.grp is None and r.reach is None for r in got)
    same = [(i, [1.0, 0.0]) for i in range(8)] + [(20, None)]
    assert [r.grp for r in density.density_groups(table(spark, same), "id", "v", 3, 2).collect()] == [None] * 8


def test_choice_by_rounds_equals_choice_in_one_task(spark):
    rng = random.Random(9)
    rows = [("c0", None, 1, None, 5.0)] + [(f"c{i}", f"c{rng.randrange(i)}", 1, 1, round(rng.random() * 4, 3)) for i in range(1, 60)]
    tree = spark.createDataFrame(rows, "cluster string, parent string, size long, at long, stability double")
    got = [Counter(map(tuple, density.choose(tree, n).collect())) for n in (3, 1000)]
    assert got[0] == got[1] and len(got[0]) == 60
    picked = tree.join(density.choose(tree), "cluster")
    tops = {r["cluster"]: r["top"] for r in density.highest_picked(picked).collect()}
    flags = {r["cluster"]: (r["parent"], r["picked"]) for r in picked.collect()}
    for c in flags:
        way, at = [], c
        while at is not None:
            way.append(at)
            at = flags[at][0]
        assert tops[c] == next((x for x in reversed(way) if flags[x][1]), None)


def test_blocks_meet_without_being_written_again(spark):
    found = metric.nearest(rows := table(spark, grouped(200, 5, 3, 9)), rows, "id", "v", 3, 16)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "hashpartitioning(a" not in plan and "BroadcastHashJoin" not in plan


def test_finished_rounds_leave_no_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tracequarry.session.shared_folder", lambda _: f"file://{tmp_path}")
    tree, _ = density.reach_tree(table(spark, grouped(60, 12, 3, 8)), "id", "v", 2, 8)
    assert tree.count() == 59
    left = [p.name.rpartition("-")[0] for p in tmp_path.glob("*/*")]
    assert left.count("density-chosen") > 1 and left.count("density-labels") <= 1 and not {"density-near", "density-out", "density-asking"} & set(left)
