import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.tables import documents, prose
from tracequarry.llm import centroid_clusters, packing, queries, ranked_search

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# clusters


def lloyd(rows, k, rounds, width):
    """The contract in Python's integers."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"2:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    centres = [kept[r][1] for r in order[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[0], []).append(v)
        centres = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centres)]
    last = [(i, *near(v)) for i, v in kept]
    most = 2**63 - 1
    each = Counter()
    for _, j, d in last:
        each[j] += d
    return Counter((i, j, min(d, most), min(each[j], most), min(sum(each.values()), most), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in last)


def clustered(spark, rows, **kwargs):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, ID long")
    return Counter(map(tuple, centroid_clusters.cluster(table, **kwargs).collect()))


def test_clusters_against_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-2, 3) / 4 + rng.choice([0, 0.001]) for _ in range(3)]) for i in range(300)]
    rows += rows[:20] + [(None, [0.5, 0.5, 0.5]), (400, None), (401, [1.0, 2.0]), (402, [1.0, None, 2.0]), (403, [1.0, float("nan"), 0.0]), (404, [float("inf"), 0.0, 0.0]), (405, [])]
    assert clustered(spark, rows, width=3, k=7, rounds=3) == lloyd(rows, 7, 3, 3)


@pytest.mark.parametrize("size", [2.0**20, 2.0**40, 1e30, 1e200])
def test_clusters_stay_exact_at_any_size(spark, size):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * size * rng.random(), float(rng.randrange(9))]) for i in range(60)] + [(99, [0.25, 0.25])]
    assert clustered(spark, rows, width=2, k=5, rounds=2) == lloyd(rows, 5, 2, 2)


def test_clusters_of_few_or_no_vectors(spark):
    assert clustered(spark, [], width=2) == Counter()
    assert clustered(spark, [(1, None)], width=2) == Counter()
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])]
    assert clustered(spark, rows, width=2, k=40) == lloyd(rows, 40, 5, 2)


def test_shortlist_holds_every_nearest_centroid():
    rng = np.random.default_rng(3)
    x = rng.integers(-2**26, 2**26, (400, 16))
    c = x[:40] + rng.integers(-1, 2, (40, 16))
    may = centroid_clusters.shortlist(x, c)
    exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert may[exact == exact.min(axis=1, keepdims=True)].all()
    assert may.sum() < may.size / 2


# packing


def check_packing(rows, texts, limit):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            want[i, n, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in held.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= limit
    return len(held), -(-sum(r.length for r in rows) // limit)


ODD = ["", None, " \n\t ", "it's we'LL 'Tis o'clock 'S", "<|startoftext|> a<|endoftext|>'ll x", "…. a…. word…, ≮ áb ≠ É́. ΑΣ. Σ ǅ ß,ẞ İ.", "a\x00b\x1cc\x85d e​f", "x_y- -z 3.14 1,000 ½ ²", "x" * 500, "日本語。テキスト", "é ≮ ́ ≠", "a`b {c} [d] ~e~ \\f"]


@pytest.mark.parametrize("limit", [16, 4096])
def test_packing_against_the_tokenizer(spark, limit):
    rng = random.Random(3)
    texts = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(rng.randrange(200), i)) for i in range(150)] + [(None, "null id"), (5, "again"), (5, "again"), (500, prose(20_000, 7))]
    table = documents(spark, [(i, t, "s") for i, t in texts]).withColumnRenamed("pos", "length").withColumnRenamed("n", "id")
    packed = packing.pack(packing.token_pieces(table, limit=limit), limit=limit).collect()
    used, least = check_packing(packed, texts, limit)
    assert used <= least * 1.01 + 1
    assert packing.pack(packing.token_pieces(table.limit(0))).count() == 0


def test_pieces_can_keep_their_ids(spark):
    (row,) = packing.token_pieces(documents(spark, [(1, "some words", "s")]), keep_ids=True).collect()
    assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in row.ids)) == row.ids_crc32 and len(row.ids) == row.length


@needs_tables
def test_packing_of_the_table(spark):
    texts = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    used, least = check_packing(queries.op12_packing(spark, SF).collect(), texts, 4096)
    assert used <= least + 1


def best_bins(lengths, limit):
    """First fit, falling: what a plain packer needs."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        for i, g in enumerate(gaps):
            if n <= g:
                gaps[i] -= n
                break
        else:
            gaps.append(limit - n)
    return len(gaps)


def test_best_two_fit_uses_up_every_piece_in_no_more_bins_than_first_fit():
    used = plain = 0
    for seed in range(40):
        rng = random.Random(seed)
        limit = rng.choice([7, 50, 300])
        counts = Counter(rng.randrange(1, limit + 1) for _ in range(rng.randrange(1, 400)))
        fillings = packing.best_two_fit(counts, limit)
        spent = Counter()
        for times, lengths in fillings:
            assert times > 0 and sum(n * k for n, k in lengths) <= limit
            for n, k in lengths:
                spent[n] += times * k
        assert spent == counts
        used += sum(t for t, _ in fillings)
        plain += best_bins(counts.elements(), limit)
    assert used <= plain


def test_two_pieces_replace_the_smallest():
    # greedy: 60 + 30 leaves 10; 20 + 19 fit the gap of 40 better than 30 does
    assert packing.best_two_fit({60: 1, 30: 1, 21: 1, 19: 1}, 100) == [(1, [(60, 1), (21, 1), (19, 1)]), (1, [(30, 1)])]


def test_the_plan_does_not_grow_with_the_counts():
    counts = {n: 1 + n * 7919 % 1000 for n in range(1, 4097)}
    few, many = packing.best_two_fit(counts), packing.best_two_fit({n: c * 10**6 for n, c in counts.items()})
    assert len(many) < 3 * len(few)


# search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    def words(t):
        return ["".join(c.lower() if c.isascii() else c for c in w) for w in TERM.findall(t or "")]

    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(words(text)).items() if c[t]
            )
            if score:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def both(spark, docs, items, k=10):
    table = documents(spark, [(i, t, "s") for i, t in docs]).withColumnRenamed("key", "item_id").withColumnRenamed("n", "rank")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return Counter(map(tuple, ranked_search.search(table, asked, k=k).collect())), ranked(docs, items, k)


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "DOCS_A_SHARD", 50)
    rng = random.Random(5)
    docs = [(i, prose(rng.randrange(60), i % 150)) for i in range(400)] + [(7, prose(30, 3)), (7, prose(30, 3)), (None, prose(40, 9)), (900, None), (901, ""), (902, " .,;"), (903, "ÉCOLE école Straße CAFÉ_a b")]
    docs.append((904, " ".join(prose(400, i) for i in range(30))))
    items = [(i, prose(12, i)) for i in range(30)] + [(50, None), (51, ""), (52, "nothing of it"), (53, "École a b"), (3, prose(12, 3)), (54, "alpha1 " * 40 + "beta2"), (None, prose(5, 1))]
    for k in (1, 10):
        got, want = both(spark, docs, items, k)
        assert got == want


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEMS_AT_ONCE", 300)
    docs, items = [(i, prose(30, i)) for i in range(60)], [(i, prose(9, i)) for i in range(20)]
    got, want = both(spark, docs, items)
    assert got == want


def test_search_of_nothing(spark):
    assert both(spark, [], [(1, "a")])[0] == Counter()
    assert both(spark, [(1, "a")], [])[0] == Counter()
    assert both(spark, [(1, None)], [(1, "a")])[0] == Counter()


@pytest.mark.parametrize("window", [1, 3, 64])
def test_windows_give_what_single_documents_give(window):
    rng = random.Random(6)
    lists = [sorted(rng.sample(range(200), rng.randrange(1, 150))) for _ in range(8)]
    adds = [[rng.randrange(1, 4) for _ in d] for d in lists]
    scores = Counter()
    for d, a in zip(lists, adds, strict=True):
        for x, y in zip(d, a, strict=True):
            scores[x] += y
    want = sorted(((s, d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:10]
    cursors = [ranked_search.Cursor(np.array(d), np.array(a)) for d, a in zip(lists, adds, strict=True)]
    assert ranked_search.best_documents(cursors, 10, window) == want


def test_numbers_round_trip():
    rng = random.Random(7)
    values = np.array([rng.randrange(2 ** rng.randrange(1, 60)) for _ in range(3000)] + [0, 127, 128, 2**35])
    data, ends = ranked_search.packed_numbers(values)
    assert (ranked_search.unpacked_numbers(data) == values).all() and ends[-1] == len(data)
    assert len(ranked_search.packed_numbers(np.zeros(0, dtype=np.int64))[0]) == 0
