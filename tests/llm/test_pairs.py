import os
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.tables import documents, prose
from tracequarry.llm import decontam, near_dups, queries


def test_shingles_are_windows_of_words():
    assert len(near_dups.shingles(None)) == 0 and len(near_dups.shingles("  ...")) == 0
    assert len(near_dups.shingles("one two")) == 1
    assert len(near_dups.shingles("a b c d e f")) == 2
    assert np.array_equal(near_dups.shingles("Ab, cd! é f g"), near_dups.shingles("ab cd É f g"))
    long = prose(70000, 3)
    words = long.split()
    assert len(near_dups.shingles(long)) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_posterior_table():
    need = near_dups.least_matches()
    assert len(need) == near_dups.SKETCH // near_dups.STEP and list(need) == sorted(need)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 256, (2000, near_dups.SKETCH), dtype=np.uint8)
    right = np.where(rng.random(left.shape) < 0.8, left, rng.integers(0, 256, left.shape, dtype=np.uint8))
    assert len(near_dups.survivors(left, right, 0.8)) >= 1995
    assert len(near_dups.survivors(left, rng.permutation(left), 0.8)) <= 2


def brute(rows):
    sets = [set(near_dups.shingles(t).tolist()) for _, t, _ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    lowest = {}
    for i, (d, _, _) in enumerate(rows):
        r = find(i)
        lowest[r] = d if r not in lowest or d is None or (lowest[r] is not None and d < lowest[r]) else lowest[r]
    return sorted(((d, lowest[find(i)] if links[i] else d, links[i]) for i, (d, _, _) in enumerate(rows)), key=str)


def near_rows():
    rows = []
    base = prose(200, 7).split()
    for i in range(60):  # a chain of near copies, larger than a bucket
        words = list(base)
        words[(3 * i) % 190] = f"edit{i}"
        words[(7 * i) % 150] = f"more{i % 5}"
        rows.append((i, " ".join(words), "s"))
    for i in range(60, 90):
        rows.append((i, prose(80, i), "s"))
    rows += [(100 + i, prose(80, 60).upper() + "!", "s") for i in range(40)]
    rows += [(200, None, None), (201, "", None), (202, "... !", None), (203, "two words", None), (204, "Two, words", None), (None, prose(80, 61), None)]
    rows += [(205, prose(30000, 5), None), (206, prose(30000, 5) + " x", None), (207, prose(90, 99), None), (207, prose(90, 99), None)]
    return rows


@pytest.mark.parametrize(("small", "block"), [(16, 384), (2, 7)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rows = near_rows()
    got = near_dups.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)
    assert len(got) == len(rows)


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    docs = documents(spark, rows)
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    classes = {(c, "x") if n else (d, t) for (d, c, n), t in zip(brute(rows), [""] * len(rows), strict=True)}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == len({c for c, _ in classes})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_links_of_the_documents_table(spark):
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = [set(near_dups.shingles(t).tolist()) for _, t, _ in rows]
    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    want = {}
    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in held[x] if j != i)
        want[rows[i][0]] = sum(n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9 for j, n in met.items())
    got = {r["doc_id"]: r["n_links"] for r in queries.op9_near_dups(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and sum(want.values()) > 100


def test_groups_over_many_chunks(spark, monkeypatch):
    for n in (60, 120):  # one bucket ties them all, few are alike
        base = prose(40, 1).split()
        rows = [(i, " ".join([*base, *prose(30, 1000 + i // 2).split(), f"w{i % 2}"]), None) for i in range(n)]
        monkeypatch.setattr(near_dups, "SMALL", 2)
        monkeypatch.setattr(near_dups, "BLOCK", 30)
        got = near_dups.near_duplicates(documents(spark, rows)).collect()
        assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)


def test_nothing_is_near(spark):
    assert near_dups.near_duplicates(documents(spark, [])).count() == 0
    alone = documents(spark, [(1, prose(50, 1), None), (2, prose(50, 2), None)])
    assert [(r["class_id"], r["n_links"]) for r in near_dups.near_duplicates(alone).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "item_id long, text string, n int, words string")


def wanted(docs, bench, threshold=0.8):
    def words(t):
        return re.sub(r"[\W_]+", " ", (t or "").lower()).split()

    def grams(w, size=5):
        return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]

    first = {}
    for i, t in bench:
        k = tuple(words(t))
        if k:
            first[k] = min(i, first.get(k, i))
    out = {}
    for d, t, _ in docs:
        for k, i in first.items():
            size = min(5, len(k))
            gs, it, n = grams(words(t), size), Counter(grams(k, size)), len(k) - size + 1
            for p in range(len(gs)):
                win = Counter(gs[p : p + n])
                same = sum((win & it).values())
                s = same / (sum(win.values()) + n - same)
                if s >= threshold and s > out.get((d, i), 0):
                    out[d, i] = s
    return {k: round(v, 6) for k, v in out.items()}


X, Y = prose(20, 90).split(), prose(20, 91).split()


@pytest.mark.parametrize("limit", [10**6, 0])
def test_contaminations_against_brute_force(spark, limit):
    bench = [(1, prose(40, 1)), (2, prose(60, 2)), (3, "a b c d"), (4, None), (5, prose(40, 1).upper()), (6, "la " * 30), (7, "Short item"), (8, ""), (9, " ".join([*X, *X, *Y]))]
    q, r = bench[0][1].split(), bench[1][1].split()
    rows = [
        (1, prose(30, 50) + " " + bench[0][1].upper().replace(" ", ", ") + prose(30, 51), "s"),
        (2, " ".join(q[:20] + ["new"] + q[20:]), "s"),
        (3, " ".join(r[3:]), "s"),
        (4, prose(20, 9) + " " + " ".join(r[:56]) + " other words follow here now", "s"),
        (5, " ".join(q[:25]), "s"),
        (6, None, "s"),
        (7, "", "s"),
        (8, bench[1][1] + "\n" + bench[0][1], "s"),
        (8, bench[1][1] + "\n" + bench[0][1], "s"),
        (9, "la " * 300, "s"),
        (10, prose(20000, 8) + " " + bench[1][1], "s"),
        (None, bench[0][1], "s"),
        (11, " ".join([*r[:30], "x", *r[31:]]), "s"),
        (12, " ".join([*X, *X, *X, *X, *X, *Y]), "s"),
        (13, prose(12, 3) + " a short, item and a B; c d!", "s"),
        (14, "short\titem", "s"),
        (15, " ".join([*X, *Y, *X, *X[:14], "z", *X[15:], *Y, *Y]), "s"),
    ]
    docs = documents(spark, rows)
    got = decontam.contaminations(docs, items(spark, bench), broadcast_shingles=limit).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == wanted(rows, bench)
    clean = decontam.drop_contaminated(docs, items(spark, bench), broadcast_shingles=limit)
    assert clean.columns == docs.columns
    bad = {d for d, _ in wanted(rows, bench)}
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {d for d, _, _ in rows} - bad


def test_nothing_to_find(spark):
    docs = documents(spark, [(1, prose(50, 1), None)])
    assert decontam.contaminations(docs, items(spark, [(1, "not there"), (2, None), (3, " ... ")])).count() == 0
    assert decontam.contaminations(documents(spark, []), items(spark, [(1, prose(50, 1))])).count() == 0
    assert decontam.contaminations(docs, items(spark, []).limit(0)).count() == 0


def test_blocks_meet_within_the_radius():
    layout = decontam.block_layout()
    assert sum(w for _, w in layout) == 64 and len(layout) == decontam.RADIUS + 1
    rng = np.random.default_rng(0)
    for _ in range(200):
        flips = rng.choice(64, decontam.RADIUS, replace=False)
        mask = sum(1 << int(b) for b in flips)
        assert any(not (mask >> at) & ((1 << w) - 1) for at, w in layout)
