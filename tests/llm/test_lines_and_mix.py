import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tests.llm.tables import documents, prose
from tracequarry.llm import line_dedup, queries, source_mix

SF = "/root/testdata/sf0.01"
LINE = "This line is repeated in many places"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    assert oracle.difference(queries.QUERIES[name](spark, SF), SF, queries.ORACLE_SQL[name]) == ""


def expected(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(line_dedup.WHITE))

    held = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or i == max(held[key(x)], key=lambda d: -1 if d is None else d)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = [LINE, "  " + LINE.upper() + "\t", "short", "", "É" + LINE, "é" + LINE, *(prose(6, i) for i in range(4))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))), "s") for i in range(40)]
    rows += [(100, None, None), (101, "", "s"), (102, LINE, "s"), (102, LINE, "s"), (None, LINE + "\nown", "s"), (103, (LINE + "\n") * 3000 + "end", "s")]
    got = line_dedup.dedup_lines(documents(spark, rows))
    assert {"key", "pos", "n"} <= set(got.columns)
    assert sorted([tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()], key=str) == expected(rows)


def test_bitmaps_are_runs(spark):
    rows = [(i, f"{LINE}\n{LINE}\nown {i}\n{LINE}", "s") for i in range(3)]
    got = {r["doc"]: (r["flips"], r["n_dropped"]) for r in line_dedup.keep_bitmaps(documents(spark, rows)).collect()}
    assert got == {0: ([0, 2, 3, 4], 3), 1: ([0, 2, 3, 4], 3)}


def test_names_that_clash(spark):
    line = "a line that is long enough to count"
    rows = [(i, f"own {i}\n{line}", 9, "x", [i], i) for i in range(4)] + [(3, f"own 3\n{line}", 9, "x", [3], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, version string, flips array<int>, `a.b` int").withColumnsRenamed({"version": "doc"})
    got = line_dedup.dedup_lines(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "n_dropped", "kept_text"])
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["doc"], r["a.b"]) for r in got.collect()) == [(i, 2, int(i < 3), "x", i) for i in (0, 1, 2, 3, 3)]
    assert line_dedup.dedup_lines(docs, out_col="text").columns.count("text") == 1


def test_lines_of_nothing(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_text_column_can_be_replaced(spark):
    rows = [(i, f"{LINE}\nown {i}", "s") for i in range(3)]
    docs = documents(spark, rows)
    got = line_dedup.dedup_lines(docs, out_col="text")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: "own 0", 1: "own 1", 2: f"{LINE}\nown 2"}


def test_shares_stop_at_the_cap():
    assert source_mix.capped_shares([10, 100, 100], [3, 1, 2], 315, 2) == pytest.approx([20, 295 / 3, 590 / 3])
    assert source_mix.capped_shares([0, 0], [3, 1], 0, 2) == [0, 0]


def test_flow_reroutes():
    # the pattern shared by both sources must serve the second, which has nothing else
    given = source_mix.route([10, 10], [[0, 1], [0]], [10, 10], 1)
    assert [sum(f.get(s, 0) for f in given) for s in (0, 1)] == [10, 10]
    given = source_mix.route([10, 4], [[0], [0, 1]], [14, 4], 2)
    assert [sum(f.get(s, 0) for f in given) for s in (0, 1)] == [14, 4]
    assert sum(given[0].values()) <= 20


def test_mix(spark):
    rows = [(i, prose(5 + i % 7, i), f"s{i % 4}" if i % 9 else None) for i in range(300)]
    rows += [(1000, None, "s0"), (1001, "", "s1"), (1002, prose(3000, 1), "s2"), (1003, "x y", "s3"), (1003, "x y", "s3"), (None, "a b c", "s0")]
    got = source_mix.mix_by_source(documents(spark, rows))
    again = source_mix.mix_by_source(documents(spark, rows[::-1]))
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted(map(tuple, again.collect()), key=str)
    assert len(found) == len(rows)
    for r in got.collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    for r in sums:
        assert r["size"] == r["source_size"]
        assert abs(r["taken"] - r["target"]) <= 1 and r["target"] <= 2 * r["source_size"]
    assert sum(r["target"] for r in sums) == pytest.approx(1.5 * sum(r["size"] for r in sums))


def test_mix_of_overlapping_sources(spark):
    rows = [(i, prose(10, i), None) for i in range(200)]
    members = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("a")))
    taken, report = source_mix.mix(documents(spark, rows), source_mix.word_count(F.col("text")), members, weights=(1, 1), ratio=1.0)
    assert {k: v["taken"] for k, v in report.items()} == {"a": 1000, "b": 1000}
    assert taken.agg(F.sum("taken")).first()[0] == 2000
    with pytest.raises(ValueError):
        source_mix.mix(documents(spark, rows), F.lit(1), members, max_patterns=2)


def test_mix_of_nothing(spark):
    assert source_mix.mix_by_source(documents(spark, [])).count() == 0


def test_kept_text_hash(spark):
    got = line_dedup.dedup_lines(documents(spark, [(1, None, None)])).select(F.sha2("kept_text", 256).alias("h")).first()["h"]
    assert got == hashlib.sha256(b"").hexdigest()
