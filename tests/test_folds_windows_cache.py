import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import parsing
from tracequarry.operators import audit, embed, jobs, markdown
from tracequarry.sources import cache


def test_fingerprints_by_fold_equal_those_by_value(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, "x", "", "y\nz"])) for i in range(300)]
    table = spark.createDataFrame(rows, "g string, ord int, line string").repartition(7)
    for by in (["g"], []):
        got, want = ({tuple(r) for r in audit.fingerprint(table, F.col("line"), ["ord"], by, most).collect()} for most in (0, 10**6))
        assert got == want
    lines = "\n".join(t for g, _, t in rows if g == "a" and t is not None)
    assert ("a", sum(g == "a" for g, *_ in rows), hashlib.sha256(lines.encode()).hexdigest()) in {tuple(r) for r in audit.fingerprint(table, F.col("line"), ["ord"], ["g"], 0).collect()}


def test_edits_of_one_document_stream_through(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = spark.createDataFrame([(1, "start"), (2, None), (1, "twin")], "doc_id long, text string")
        edits = spark.createDataFrame([(1, i, i, "append" if i % 5 else "replace", "nowhere", f"line {i}") for i in range(60)] + [(9, 0, 0, "append", "", "lost")], "doc_id long, ord int, edit_id long, op string, target string, content string")
        got = {(r.doc_id, r.text.split("\n")[0]): r for r in markdown.fold_edits(docs, edits).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {(1, "start"), (1, "twin"), (2, "")}
    assert got[1, "twin"].applied == [str(i) for i in range(60) if i % 5] and got[1, "start"].text.endswith("line 58\n\nline 59\n")
    assert got[1, "start"].failed == [f"{i}:target_not_found" for i in range(0, 60, 5)]


@pytest.mark.parametrize("text", ['{"a":' * 100_000, "[" * 100_000, "{" * 100_000, '{"' * 50_000, '{"a":' * 50_000 + "1" + "}" * 50_000, "(" * 50_000, '{"x": "' + "{" * 50_000])
def test_deep_nesting_and_broken_texts_are_no_objects(text):
    assert parsing.first_object(text) is None
    assert parsing.code_of(text) == parsing.FALLBACK_CODE
    assert isinstance(parsing.redact_value(text), str)


def test_objects_are_found_behind_what_does_not_decode():
    assert parsing.first_object('{"a":' * 50_000 + "1" + "}" * 50_000 + ' then {"ok": 1}') == '{"ok": 1}'
    assert parsing.first_object('x {"a {"b": 1}') == '{"b": 1}'
    assert parsing.first_object('{"a": {"b": 1} x {"c": 2}') == '{"b": 1}'
    assert parsing.first_object('{"q": "\\"{"} tail') == '{"q": "\\"{"}'
    assert parsing.first_object('[{"a": 1}]') is None and parsing.first_object(None) is None


def cards(spark, n=60):
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, i % 7, None if i % 20 == 19 else [x + rng.gauss(0, 0.1) for x in middles[i % 3]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, round int, embedding array<double>")


@pytest.mark.parametrize(("mode", "extra"), [("card", {}), ("round", {}), ("auto", {"dataset": "ScienceWorld"}), ("semantic", {"clustering": "graph"}), ("semantic", {})])
def test_every_card_has_a_window_of_bounded_size(spark, mode, extra):
    made = embed.evidence_windows(cards(spark), "id", "id", mode, most=8, **extra).collect()
    assert sorted(r.id for r in made) == list(range(60))
    sizes = {}
    for r in made:
        sizes.setdefault(r.window, []).append(r.id)
    assert max(map(len, sizes.values())) <= 8
    if extra.get("dataset"):
        assert all(len({i % 7 for i in ids}) == 1 for ids in sizes.values())
    if mode == "semantic":
        assert all(len({i % 3 for i in ids if i % 20 != 19}) <= 1 for w, ids in sizes.items() if not w.startswith("small"))


def test_unknown_groupings_are_refused(spark):
    with pytest.raises(ValueError, match="unknown grouping"):
        embed.evidence_windows(cards(spark, 3), "id", "id", "other")


def test_windows_of_many_small_groups_are_cut_within_ranges(spark):
    rows = spark.range(400).select("id", (F.col("id") / 3).cast("int").alias("g"))
    got, want = ({tuple(r) for r in embed.pack_windows(rows, "id", "g", 4, 20, n).collect()} for n in (10, 10**6))
    assert got == want


def test_the_cache_stays_in_its_buckets(spark, tmp_path):
    name, other = (f"cache_{uuid.uuid4().hex}" for _ in range(2))
    first = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("", [3.0]), (None, [3.0]), ("c", None), ("d", [None])], "cache_key string, embedding array<double>")
    cache.appended(first, name, str(tmp_path / "one"), 4, 1)
    cache.appended(spark.createDataFrame([("b", [5.0]), ("e", [6.0]), ("e", [7.0])], "cache_key string, embedding array<double>"), name, str(tmp_path / "one"), 4, 2)
    keyed = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "b", "c", None, "e"])], "id int, cache_key string")
    assert sorted(r.id for r in cache.misses(keyed, name).collect()) == [2, 3]
    assert {(r.id, r.embedding[0]) for r in cache.hits(keyed, name).collect()} == {(0, 1.0), (1, 5.0), (4, 7.0)}
    for df in (cache.misses(keyed, name), cache.hits(keyed, name)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        moved = "".join(plan[plan.index("Exchange") :].split("\n")[1:3])
        assert plan.count("Exchange") == 1 and "Scan ExistingRDD" in moved and "Bucketed: true" in plan, plan
    cache.compacted(spark, name, other, str(tmp_path / "two"), 4)
    assert "Exchange" not in cache.rows_of(spark, name)._jdf.queryExecution().executedPlan().toString()
    assert {(r.cache_key, r.embedding[0]) for r in spark.table(other).collect()} == {("a", 1.0), ("b", 5.0), ("e", 7.0)}


def test_the_table_function_says_what_it_lacks(spark):
    jobs.register(spark)
    spark.createDataFrame([("e", "t")], "edit_id string, task_id string").createOrReplaceTempView("few")
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM replay_jobs(TABLE(few))").collect()
