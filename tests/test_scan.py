import random

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import scan, trajectory


def steps(spark, n, hot=0.9, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < hot else rng.choice(["a", "b", None]), i, rng.choice(["go", "go", "look", "", None]), rng.choice([None, i / 8])) for i in range(n)]
    return spark.createDataFrame(rows, "task string, ord int, action string, score double").repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most", [20])
def test_scans_of_a_hot_key_equal_plain_windows(spark, most):
    table = steps(spark, 400)
    for make in (
        lambda m: trajectory.ranked(table, "task", ["ord"], m).select("task", "ord", "rn", "rev"),
        lambda m: trajectory.history(table, "task", "ord", F.col("action"), 8, m).select("task", "ord", "history"),
        lambda m: trajectory.history(table, "task", "ord", F.col("score"), 3, m).select("task", "ord", "history"),
        lambda m: trajectory.transitions(table, "task", "ord", "score", most=m).select("task", "ord", "score_before", "score_delta"),
        lambda m: trajectory.run_lengths(table, "task", "ord", "action", most=m),
        lambda m: trajectory.step_rows(table, "task", ["ord"], "head_tail", head=2, tail=5, most=m).select("task", "ord"),
        lambda m: scan.runs(table, "task", ["ord"], F.col("action"), m),
    ):
        assert rows_of(make(most)) == rows_of(make(1_000_000))


def test_a_hot_key_spans_ranges_of_bounded_size(spark):
    dealt = scan.ranges(steps(spark, 2_000, 1.0), "task", ["ord"], 50)
    sizes = [r["count"] for r in dealt.groupBy(scan.PART).count().collect()]
    assert len(sizes) >= 30 and max(sizes) < 200


def test_runs_by_brute_force(spark):
    table = steps(spark, 120)
    want = []
    by_task = {}
    for r in sorted(table.collect(), key=lambda r: r["ord"]):
        by_task.setdefault(r["task"], []).append(r["action"])
    for task, actions in by_task.items():
        found = []
        for a in actions:
            if found and found[-1][0] == a:
                found[-1][1] += 1
            else:
                found.append([a, 1])
        want += [(task, i, a, n) for i, (a, n) in enumerate(found, 1)]
    assert rows_of(scan.runs(table, "task", ["ord"], F.col("action"), 9)) == sorted(want, key=str)


def test_empty_tables_stay_empty(spark):
    none = steps(spark, 1).limit(0)
    assert trajectory.ranked(none, "task", ["ord"], 0).count() == scan.runs(none, "task", ["ord"], F.col("action"), 0).count() == 0
