"""Streams against the same computation in batch."""

from datetime import datetime

import pandas as pd

from tracequarry.streaming import ordered, runs


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(60)
    return df.sparkSession.table(name)


def stream_of(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_running_summary(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, 1.0), ("a", False, 0.0), ("b", None, 1.0)], "mode string, success boolean, score double").repartition(3)
    got = drain(runs.running_summary(stream_of(spark, rows, str(tmp_path / "in"))), "summary", "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in runs.running_summary(rows).collect()}


def test_bundles_over_several_batches(spark, tmp_path):
    first = spark.createDataFrame([(0, "x"), (1, "y")], "bundle int, v string")
    stream = stream_of(spark, first.coalesce(1), str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    runs.write_bundles(stream, out, mark).awaitTermination(60)
    spark.createDataFrame([(1, "z")], "bundle int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert runs.kept_running(lambda: runs.write_bundles(stream, out, mark)) == 0
    assert {(r["bundle"], r["v"]) for r in runs.read_bundles(spark, out).collect()} == {(0, "x"), (1, "y"), (1, "z")}


def test_failing_streams_are_started_again():
    class Failing:
        tries = 0

        def awaitTermination(self):
            Failing.tries += 1
            if Failing.tries < 3:
                raise RuntimeError("lost")

    assert runs.kept_running(Failing, wait=0) == 2


def test_order_over_arrow_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = [("e", 9 - i, "reactivate" if i == 0 else "reject") for i in range(10)]
        stream = stream_of(spark, spark.createDataFrame(rows, "evidence_id string, ord int, outcome string").coalesce(1), str(tmp_path / "in"))
        got = drain(runs.lifecycle(stream), "ordered", "update").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["rejects"], r["status"]) for r in got] == [(0, "active")]


def test_lifecycle(spark, tmp_path):
    rows = spark.createDataFrame([("e", 0, "reject"), ("e", 1, "reject"), ("f", 0, "accept"), ("f", 1, "reactivate")], "evidence_id string, ord int, outcome string")
    got = drain(runs.lifecycle(stream_of(spark, rows.coalesce(1), str(tmp_path / "in"))), "life", "update")
    assert {r["evidence_id"]: (r["attempts"], r["rejects"], r["status"]) for r in got.collect()} == {"e": (2, 2, "stale"), "f": (1, 0, "active")}


def test_count_windows(spark, tmp_path):
    rows = spark.createDataFrame([("p", i, f"E{i}") for i in range(7)], "pool string, ord int, evidence_id string")
    got = drain(runs.count_windows(stream_of(spark, rows.coalesce(1), str(tmp_path / "in")), "pool", 3), "windows", "append")
    assert [r["evidence_ids"] for r in got.orderBy("window").collect()] == [["E0", "E1", "E2"], ["E3", "E4", "E5"]]


def test_windowed_rewards(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id*4 as int)) as ts, 1.0d as reward from range(10)")
    got = drain(runs.windowed_rewards(stream_of(spark, rows.coalesce(1), str(tmp_path / "in")), "ts"), "rewards", "update")
    assert sum(r["steps"] for r in got.collect()) == 10


def in_batches(spark, tmp_path, batches, schema, make):
    """What a stream has put out when each batch has come by itself and the query was started anew for it."""
    ordered.use_rocksdb(spark)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ordered.to_folder(make(spark.readStream.schema(schema).parquet(source)), out, mark).awaitTermination()
    return spark.read.parquet(out)


def at(minute):
    return datetime(2024, 1, 1, minute // 60, minute % 60)


def test_order_holds_over_micro_batches_and_restarts(spark, tmp_path):
    schema = "evidence_id string, ord int, ts timestamp, outcome string"
    # the reactivation comes a batch before the rejects that precede it in time; the last batch only moves the watermark
    batches = [
        [("e", 9, at(9), "reactivate"), ("f", 0, at(1), "accept")],
        [("e", 2, at(2), "reject"), ("e", 3, at(2), "reject"), ("f", 1, at(3), "reactivate")],
        [("z", 0, at(200), "attempt")],
    ]
    got = in_batches(spark, tmp_path, batches, schema, lambda s: ordered.lifecycle(s, "ts", "30 minutes"))
    found = {(r.evidence_id, r.ord): (r.attempts, r.rejects, r.status) for r in got.collect()}
    assert found == {("e", 2): (1, 1, "active"), ("e", 3): (2, 2, "stale"), ("e", 9): (2, 0, "active"), ("f", 0): (1, 0, "archived"), ("f", 1): (1, 0, "active")}


def test_idle_keys_are_forgotten(spark, tmp_path):
    schema = "evidence_id string, ord int, ts timestamp, outcome string"
    batches = [[("e", 0, at(1), "reject"), ("z", 0, at(100), "attempt")], [("z", 1, at(200), "attempt")], [("e", 1, at(201), "reject"), ("z", 2, at(300), "attempt")]]
    got = in_batches(spark, tmp_path, batches, schema, lambda s: ordered.lifecycle(s, "ts", "10 minutes", idle_ms=20 * 60_000))
    assert {(r.evidence_id, r.ord): r.rejects for r in got.where("evidence_id = 'e'").collect()} == {("e", 0): 1, ("e", 1): 1}


def test_ordered_count_windows(spark, tmp_path):
    schema = "pool string, ord int, ts timestamp, evidence_id string"
    batches = [[("p", i, at(i), f"E{i}") for i in (5, 1, 3)], [("p", i, at(i), f"E{i}") for i in (4, 0, 2)], [("q", 9, at(90), "x")]]
    got = in_batches(spark, tmp_path, batches, schema, lambda s: ordered.count_windows(s, "pool", "ts", 4, "20 minutes"))
    assert [(r.pool, r.window, r.evidence_ids) for r in got.collect()] == [("p", 0, ["E0", "E1", "E2", "E3"])]


def test_rows_of_a_key_cost_two_messages():
    calls = []

    class Counted:
        def __getattr__(self, name):
            return lambda *args: calls.append(name) or self

    made = ordered.Lifecycle("ts", 2, None)
    made.init(Counted())
    calls.clear()
    rows = pd.DataFrame({"ts": [at(1), at(2)], "ord": [1, 2], "outcome": ["reject", "accept"]})
    assert list(made.handleInputRows(("e",), iter([rows]), None)) == []
    assert calls == ["appendList", "registerTimer"]
