"""Cards, rendered texts and manifests on edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import render
from tracequarry.operators import cards
from tracequarry.sources import manifests

STEP = "array<struct<step:int,observation:string,action:string,next_observation:string,score_before:double,score_after:double,score_delta:double>>"


def say(spark, column, rows):
    return spark.range(1).select(F.from_json(F.lit(json.dumps(rows)), STEP).alias("s")).select(column(F.col("s"))).first()[0]


def test_histories(spark):
    rows = [{"step": 3, "observation": "o", "action": "a"}, {"step": 4, "action": "b", "next_observation": "n", "score_before": 0.25, "score_after": 1.0, "score_delta": 0.75}]
    assert say(spark, render.plain_history, rows) == "Step 3: observation=o action=a\nStep 4: action=b"
    assert say(spark, render.plain_history, []) == "None"
    assert say(spark, render.bracketed_history, rows[:1]) == "[Observation 4: 'o', Action 4: 'a']"
    assert say(spark, render.scored_history, []) == "No previous steps."
    want = "Step 4\nObservation: \nAction: b\nResult: n\nScore: 0.25 -> 1 (delta +0.75)"
    assert say(spark, render.scored_history, rows[1:]) == want
    assert say(spark, render.scored_history, rows[:1]).endswith("Score: unavailable")


def test_edit_texts(spark):
    edits = F.from_json(F.lit('[{"op":"Append","content":"a\\nb"},{"op":"delete","target":"t"}]'), "array<struct<op:string,target:string,content:string>>")
    none = F.slice(edits, 1, 0)
    row = spark.range(1).select(render.short_edits(edits), render.short_edits(none), render.update_summary(edits), render.update_summary(none)).first()
    assert row[0] == "append:a b; delete:t" and row[1] == "no edits"
    assert row[2].endswith("1. op: Append\ntarget: null\ncontent:\na\nb\n\n2. op: delete\ntarget: t\ncontent:\n(empty)")
    assert row[3].startswith("No skill edits")
    text = spark.range(1).select(render.memory_input(*(F.lit(x) for x in ("a", "b", " ", "c", "d")))).first()[0]
    assert text.startswith("## Previous Epoch's Skill\na\n\n## Current") and "(No previous longitudinal memory.)" in text


@pytest.mark.parametrize(
    ("status", "said", "want"),
    [
        (400, "Maximum context length is 8,192 tokens; prompt contains 4,000 input tokens: context length", 3936),
        (400, "maximum context length is 8192 tokens, prompt contains at least 4000 input tokens", 2048),
        (400, "context length", None),
        (500, "maximum context length is 8192 tokens, prompt contains 10 input tokens", None),
        (400, "maximum context length is 100 tokens, prompt contains 90 input tokens", 2),
    ],
)
def test_retry_budget(spark, status, said, want):
    assert spark.range(1).select(render.retry_budget(F.lit(status), F.lit(said), F.lit(4096))).first()[0] == want


def test_cards(spark):
    rows = spark.createDataFrame([("M1", 0, "", ["E2", "E1"]), ("M2", 1, "x", []), ("M3", 2, "y", ["E9"])], "edit_id string, ord int, content string, evidence_ids array<string>")
    payload = {r["edit_id"]: r for r in cards.edit_payload(rows).collect()}
    assert payload["M1"]["content"] is None and payload["M2"]["evidence_ids"] is None
    pool = spark.createDataFrame([("E1", ["W1", "W2"]), ("E2", ["W2", ""]), ("E3", None)], "evidence_id string, origin_edit_ids array<string>")
    assert [r["edit_id"] for r in cards.linked(rows, pool).collect()] == ["M1"]
    assert [tuple(r) for r in cards.origin_edits(rows, pool).collect()] == [("M1", ["W2", "W1"])]
    assert [r["edit_id"] for r in cards.within_budget(rows, "ord", 2).collect()] == ["M1", "M2"]
    assert cards.within_budget(rows, "ord", 0).count() == 3
    assert cards.new_records(rows, 1, "ord").first()["support_events"] == 0
    kept, dropped = cards.judged(spark.createDataFrame([("a", "Keep"), ("b", "drop"), ("c", None)], "evidence_id string, decision string"))
    assert [r[0] for r in kept.collect()] == ["a"] and dropped.count() == 2
    drafts = spark.createDataFrame([("E1", 0, "t", 1, 2), ("E1", 1, "t", 8, 9), ("E2", 0, "none", 0, 9)], "evidence_id string, nth int, task_id string, start int, end int")
    steps = spark.createDataFrame([("t", i, f"a{i}", "o") for i in range(4)], "task_id string, step int, action string, observation string")
    good, bad = cards.materialised(drafts, steps)
    assert [s["action"] for s in good.first()["before_segment"]] == ["a1", "a2"] and bad.count() == 2
    batches = cards.minibatches(steps.withColumn("success", F.col("step") == 0), F.col("success"), ["step"], 2)
    assert {r["step"]: r["minibatch"] for r in batches.collect()} == {0: "success:0", 1: "failure:0", 2: "failure:0", 3: "failure:1"}
    results = spark.createDataFrame([("t", 0, False, 0.0), ("t", 1, True, 1.0)], "task_id string, ord int, success boolean, score double")
    assert cards.with_outcomes(steps.limit(1), results).first()["success"] is True
    assert cards.gate(1, 2) and not cards.gate(2, 2) and cards.gate(2, 2, True)


def test_manifests(spark, tmp_path):
    files = ["/data/json_2.1.1/train/x/game", "json_2.1.1/valid_seen/y/game", "other/game"]
    df = spark.createDataFrame([(f,) for f in files], "p string")
    got = df.select(manifests.canonical_file(F.col("p")), manifests.source_split(F.col("p")), manifests.evaluation_split(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("json_2.1.1/train/x/game", "train", "train"), ("json_2.1.1/valid_seen/y/game", "valid_seen", "eval_in_distribution"), ("other/game", "unknown", None)]
    (tmp_path / "m.json").write_text('[{"id": "a", "gamefile": "g"}, {"id": "b"}]')
    with pytest.raises(Exception, match="without gamefile"):
        manifests.read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert manifests.count_of(str(tmp_path / "m.json")) == 2 and manifests.count_of(None) is None
    rows = spark.createDataFrame([(0, "g", "pick_and_place_simple"), (1, "h", "nope")], "pos int, gamefile string, task_type string")
    assert manifests.canonical_test(rows.where("pos = 0"), "pos").first()["id"] == "test:0000"
    with pytest.raises(Exception, match="unknown task type"):
        manifests.canonical_test(rows, "pos").collect()
    for name in ("tasks", "datasets"):
        (tmp_path / "data" / name).mkdir(parents=True)
    root = manifests.data_root(str(tmp_path))
    assert root.endswith("/data")
    (tmp_path / "data/datasets/dev.txt").write_text("f_2\nf_1\n")
    sides = spark.createDataFrame([("f_1",), ("f_2",)], "task_id string")
    assert [tuple(r)[:4] for r in manifests.official_split(spark, root, "dev", sides).orderBy("ord").collect()] == [(0, "f_2", "f", 2), (1, "f_1", "f", 1)]
    with pytest.raises(Exception, match="no files for"):
        manifests.official_split(spark, root, "dev", sides.limit(1)).collect()
    with pytest.raises(FileNotFoundError):
        manifests.data_root(str(tmp_path / "none"))
    for name in ("train", "val"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "items.json").write_text("[]")
    assert manifests.sibling(str(tmp_path / "train/items.json"), "val") == str(tmp_path / "val/items.json")
    assert manifests.sibling(None, "val") is None
    assert (manifests.target_count(0, 5), manifests.target_count(3, None), manifests.target_count(9, 5)) == (5, 3, 5)
