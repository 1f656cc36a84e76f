import hashlib
import random
"""Operators on edge cases and by properties."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracequarry.operators import audit, compare, config, embed, evaluate, graph, ledger, markdown, membership, sampling, trajectory
from tracequarry.operators.graph import components
from tracequarry.sources import records

REGION = "<!-- LONGITUDINAL_MEMORY_START -->\nkeep\n<!-- LONGITUDINAL_MEMORY_END -->\n"


def steps_of(numbers):
    return F.from_json(F.lit(json.dumps([{"step": n, "action": f"a{i}"} for i, n in enumerate(numbers)])), "array<struct<step:int,action:string>>")


@pytest.mark.parametrize(
    ("numbers", "mode", "want"),
    [
        ([], "tail", []),
        ([1, 2, 3], "full", ["a0", "a1", "a2"]),
        ([1, 2, 3], "tail", ["a1", "a2"]),
        ([1, 2, 3, 4], "head_tail", ["a0", "a2", "a3"]),
        ([1, 1, 2], "head_tail", ["a0", "a2"]),
        ([1, 2], "prefix", ["a0", "a1"]),
    ],
)
def test_select_steps(spark, numbers, mode, want):
    got = spark.range(1).select(trajectory.select_steps(steps_of(numbers), mode, limit=2, head=1, tail=2).alias("s")).first()["s"]
    assert [s["action"] for s in got] == want


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        trajectory.select_steps(F.col("x"), "middle")


def test_run_lengths(spark):
    rows = [("t", i, a) for i, a in enumerate(["go", "go", " ", "look", "go", "go", "go"])] + [("u", 0, None)]
    df = spark.createDataFrame(rows, "task string, step int, action string")
    assert [tuple(r) for r in trajectory.run_lengths(df, "task", "step", "action").collect()] == [("t", "go x2 -> look -> go x3")]
    cut = trajectory.run_lengths(df, "task", "step", "action", limit=2).first()["sequence"]
    assert cut == "go x2 -> [truncated]"


def test_compact_text_of_nothing(spark):
    empty = F.from_json(F.lit("[]"), "array<struct<step:int,thought:string,observation:string,action:string,next_observation:string>>")
    assert spark.range(1).select(trajectory.compact_text(empty)).first()[0] == "(empty trajectory)"


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "success boolean, score double")
    assert tuple(evaluate.summarise(none, F.col("success"), F.col("score")).first()) == (0, 0.0, 0.0)


def test_pairs(spark):
    items = spark.createDataFrame([(i, "f") for i in range(6)], "task int, task_family string")
    a = spark.createDataFrame([(0, False, 0.0, 1), (1, True, 1.0, 1), (2, False, 0.0, 1), (3, True, 1.0, 1)], "task int, success boolean, score double, steps int")
    b = spark.createDataFrame([(0, True, 1.0, 2), (1, False, 0.0, 2), (2, False, 0.0, 2), (3, True, 1.0, 2), (4, True, 1.0, 2)], a.schema)
    pairs = compare.longitudinal_pairs(items, a, b, "task")
    assert {r["task"]: r["category"] for r in pairs.collect()} == {0: "improved", 1: "regressed", 2: "persistent_fail", 3: "stable_success", 4: "improved"}
    assert dict(compare.category_counts(pairs.limit(0)).collect()) == dict.fromkeys(("improved", "regressed", "persistent_fail", "stable_success"), 0)
    report = compare.comparison_text(pairs.withColumns({"id": F.col("task"), "task": F.lit("do")}), "id").first()["report"]
    assert report.startswith("## Longitudinal Comparison Summary\nTotal samples: 5\n- Improved (fail -> success): 2\n")
    assert report.index("### Regressions") < report.index("### Persistent") < report.index("### Improvements") < report.index("### Stable")


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.3), ("a", 2, 0.2)], "k string, ord int, s double")
    assert [tuple(r) for r in compare.last_wins(df, "k", ["ord"], {"s": F.col("s")}).collect()] == [("a", 0.3)]


def test_audits(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("a", "y"), ("a", None)], "split string, id string")
    assert {tuple(r) for r in audit.overlaps(rows, "split", "id").collect()} == {("x", "a", "b"), ("x", "a", "c"), ("x", "b", "c")}
    have = audit.positions(spark.createDataFrame([("p", 0), ("q", 1), ("r", 2)], "id string, o int"), "id", ["o"])
    want = audit.positions(spark.createDataFrame([("p", 0), ("q", 1)], "id string, o int"), "id", ["o"])
    assert tuple(audit.order_mismatch(have, want).first()) == (2, "r", "<extra>")
    assert audit.order_mismatch(have, have).count() == 0
    index = spark.createDataFrame([("p", 0), ("nope", 1)], "k string, i int")
    with pytest.raises(Exception, match="no row for index"):
        audit.select_by_index(spark.createDataFrame([("p",)], "id string"), "id", index, "k", "i").collect()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 40), st.integers(1, 7), st.integers(0, 5))
def test_bundles_partition_the_manifest(spark, n, size, seed):
    manifest = spark.range(n).select("id", (F.col("id") % 3).cast("string").alias("family"))
    for made in (sampling.shuffle_epoch_bundles(manifest, "id", size, seed), sampling.family_epoch_bundles(manifest, "id", "family", size, seed)):
        rows = made.select("id", "pos", "bundle").collect()
        assert sorted(r["pos"] for r in rows) == list(range(n))
        assert {r["id"] for r in rows} == set(range(n))
        assert all(r["bundle"] == r["pos"] // size for r in rows)


def test_balance_and_strata(spark):
    manifest = spark.range(60).select("id", (F.col("id") % 4).alias("family"), (F.col("id") % 10).alias("scenario"))
    counts = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "family long, n int")
    got = sampling.balanced_by_count(manifest, "id", "family", counts, "n", 10, 1).collect()
    assert {r["family"] for r in got} == {3}
    split = sampling.stratified_split(manifest, "id", "family", "scenario", 3, 1)
    assert {r["n"] for r in split.groupBy("family").agg(F.count_distinct("scenario").alias("n")).collect()} == {3}
    low = spark.createDataFrame([(1,), (2,)], "id long")
    half = sampling.half_low_sample(manifest, "id", low, "id", 8, 1).collect()
    assert len(half) == 8 and {1, 2} <= {r["id"] for r in half}
    mixed = sampling.mixed_bundle(manifest, "id", "family", "scenario", 8, 1, 1, 2).collect()
    assert len({r["id"] for r in mixed}) == 8 and len({r["family"] for r in mixed}) == 1


def edits(spark, *rows):
    schema = "ord int, edit_id string, op string, target string, content string, evidence_ids array<string>, source_type string, support_count int, merge_level int"
    return spark.createDataFrame(list(rows), schema)


def test_coalesce_edits(spark):
    df = edits(
        spark,
        (0, "A", " Append ", None, "x ", ["e2", "e1"], "rule", 1, None),
        (1, "B", "append", "", "x", ["e1", " e3", ""], "model", 4, 2),
        (2, "C", "", None, "x", None, None, None, None),
        (3, "D", None, None, "x", None, None, None, None),
    )
    got = {r["edit_id"]: r for r in ledger.coalesce_edits(df).collect()}
    assert set(got) == {"A", "C", "D"}
    assert got["A"]["evidence_ids"] == ["e2", "e1", "e3"]
    assert (got["A"]["source_type"], got["A"]["support_count"], got["A"]["merge_level"], got["A"]["merged_from"]) == ("mixed", 4, 2, ["A", "B"])
    assert got["C"]["merged_from"] is None


def test_coalesced_provenance(spark):
    rows = [(0, "A", ["s1"], ["miss"], ["p"], "c1"), (1, "B", ["s2", "s1"], None, ["q", "p"], "c2"), (2, "C", None, ["wrong", "miss"], [""], None), (3, "D", ["s9"], [], None, "c9")]
    df = spark.createDataFrame(rows, "ord int, edit_id string, source_edit_ids array<string>, failure_types array<string>, patterns array<string>, candidate_id string")
    df = df.withColumns({"op": F.lit("append"), "target": F.lit(""), "content": F.when(F.col("ord") < 3, "x").otherwise("y"), "evidence_ids": F.array(F.lit("e")), "source_type": F.lit(None).cast("string"), "support_count": F.lit(1), "merge_level": F.lit(0)})
    got = {r["edit_id"]: r for r in ledger.coalesce_edits(df).collect()}
    assert got["A"]["source_edit_ids"] == ["s1", "s2", "c1", "c2"] and got["D"]["source_edit_ids"] == ["s9"]
    assert got["A"]["failure_types"] == ["miss", "wrong"] and got["A"]["patterns"] == ["p", "q"] and got["D"]["patterns"] == []
    assert got["A"]["merged_from"] == ["A", "B", "C"] and got["D"]["merged_from"] is None and got["A"]["source_type"] is None


def test_short_strata_fail(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"s{i // 4}") for i in range(20)], "id int, kind string, scenario string")
    assert sampling.stratified_split(rows, "id", "kind", "scenario", 5, 1).count() == 10
    with pytest.raises(Exception, match="too few scenarios"):
        sampling.stratified_split(rows, "id", "kind", "scenario", 6, 1).collect()
    assert sampling.bundle_counts(10, 4, 3) == (3, 9)
    assert sampling.looked_up(spark.createDataFrame([(1,), (99,)], "id int"), rows, "id").where("kind is null").count() == 1


def test_family_turns(spark):
    rows = spark.createDataFrame([(i, "big" if i < 40 else "mid" if i < 52 else "one") for i in range(53)], "id int, family string")
    got = [r["family"] for r in sampling.family_epoch_bundles(rows, "id", "family", 4, 3).orderBy("pos").collect()]
    assert len(got) == 53 and set(got[:3]) == {"big", "mid", "one"} and got[27:] == ["big"] * 26
    assert all(set(got[i : i + 2]) == {"big", "mid"} for i in range(3, 25, 2))
    at = {r["pos"]: r["bundle"] for r in sampling.family_epoch_bundles(rows, "id", "family", 4, 3).collect()}
    assert sorted(at) == list(range(53)) and all(b == p // 4 for p, b in at.items())


def test_small_groups_join_by_centroid(spark):
    rows = [(i, "a", [1.0, 0.01 * i]) for i in range(5)] + [(10 + i, "b", [0.01 * i, 1.0]) for i in range(5)] + [(20, "c", [0.9, 0.1]), (21, "d", [-1.0, -1.0])]
    got = dict(embed.merged_by_centroid(spark.createDataFrame(rows, "id int, g string, v array<double>"), "id", "g", "v").collect())
    assert got[20] == "a" and got[21] == "d" and got[0] == "a" and got[12] == "b"
    near = embed.nearest(spark.createDataFrame(rows[:3], "id int, g string, v array<double>"), spark.createDataFrame(rows, "id int, g string, v array<double>"), "id", "v", 2, block=4)
    assert near.count() == 6


def test_modes_logs_and_scenarios(spark):
    rows = spark.createDataFrame([("m", "appworld", f"f_{i % 2}_{i}", None, True, 1.0) for i in range(6)] + [("m", "appworld", "g_1", "fam", False, 0.0)], "mode string, dataset string, task_id string, task_family string, success boolean, score double")
    logs = spark.createDataFrame([(1, 2), (None, 3)], "accepted_count int, committed_count int").select(F.struct("accepted_count", "committed_count").alias("l2"))
    got = evaluate.mode_sums(rows, logs, F.col("success"), F.col("score")).first()
    assert (got["tasks"], got["accepted_edits"], got["committed_edits"]) == (7, 1, 5)
    done = evaluate.scenario_completion_of(rows, "dataset", F.col("success")).first()
    assert done["scenarios"] == 3 and round(done["scenario_completion"], 3) == 66.667
    other = rows.withColumn("dataset", F.when(F.col("task_id") == "g_1", "x").otherwise(F.col("dataset")))
    assert evaluate.scenario_completion_of(other, "dataset", F.col("success")).count() == 0


def test_documents_take_all_edits_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id int, text string")
    todo = spark.createDataFrame([(1, 0, "x", "replace", "a", "A"), (1, 1, "y", "replace", "zz", "A"), (2, 0, "x", "replace", "c", "C")], "doc_id int, ord int, edit_id string, op string, target string, content string")
    got = {r["doc_id"]: (r["text"], r["applied"]) for r in markdown.fold_edits(docs, todo, whole=True).collect()}
    assert got == {1: ("a b", []), 2: ("C", ["x"])}
    assert markdown.apply_all("a", [{"op": "replace", "target": "a", "content": "b"}]) == ("b", [""])
    assert markdown.apply_all("a", [{"op": "replace", "target": "a", "content": "b"}, {"op": "x"}]) == ("a", ["", "unknown_op"])


def test_ids_and_pool(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"X{i}") for i in range(9000)], "ord int, id string")
    made = ledger.assign_ids(df, "id", "E", 1, "ord").where("ord % 2 = 1").orderBy("ord").select("id").collect()
    assert [r["id"] for r in made] == [f"E{i:06d}" for i in range(1, 4501)]
    cards = spark.createDataFrame([("a", True, None), ("b", False, "stale"), ("c", None, None)], "evidence_id string, archived boolean, l2_status string")
    assert dict(ledger.pool_counts(cards).collect()) == {"archived": 1, "stale": 1, "active": 1}


def picked_in_turn(jobs, edits, seed, limit):
    """The rule one pick after the other, for one list."""
    chosen, covered = {}, set()

    def take(edit, job):
        row = chosen.setdefault(job["task_id"], {**job, "origin": []})
        if edit not in row["origin"]:
            row["origin"].append(edit)

    for edit in edits:
        own = [j for j in jobs if j["edit_id"] == edit and j["rn"] == 1]
        if own and (own[0]["task_id"] in chosen or len(chosen) < limit):
            take(edit, own[0])
            covered.add(edit)

    def key(j):
        lot = hashlib.sha256(f"{seed}:{j['edit_id']}:{j['task_id']}:{j['rn']}".encode()).hexdigest()
        return (j["edit_id"] in covered, -j["support_count"], j["task_family"], j["task_id"], j["edit_id"], lot)

    for j in sorted(jobs, key=key):
        if len(chosen) >= limit:
            break
        take(j["edit_id"], j)
    return [(j["task_id"], j["edit_id"], j["start"], tuple(j["origin"])) for j in chosen.values()]


@pytest.mark.parametrize("limit", [0, 1, 4, 9, 50])
def test_picked_tasks_equal_picks_in_turn(spark, limit):
    rng = random.Random(limit)
    edits = [(f"L{i % 4}", f"e{i}", i) for i in range(40)]
    jobs = []
    for _, e, _ in edits[:-3]:
        jobs += [(e, f"t{rng.randrange(12)}", rng.choice(["", "f"]), "c", n, n + 1, rng.randrange(1, 4), n + 1) for n in range(rng.randrange(5))]
    names = ["edit_id", "task_id", "task_family", "evidence_id", "start", "end", "support_count", "rn"]
    made = ledger.picked_tasks(
        spark.createDataFrame(jobs, "edit_id string, task_id string, task_family string, evidence_id string, start long, end long, support_count long, rn int"),
        spark.createDataFrame(edits, "list string, edit_id string, ord int"), "list", 7, limit,
    ).collect()
    for k in range(4):
        own = [e for which, e, _ in edits if which == f"L{k}"]
        want = picked_in_turn([dict(zip(names, j, strict=True)) for j in jobs if j[0] in own], own, 7, limit)
        got = sorted((r for r in made if r["list"] == f"L{k}"), key=lambda r: r["place"])
        assert [r["place"] for r in got] == list(range(len(got)))
        assert [(r["task_id"], r["edit_id"], r["start"], tuple(r["origin_edit_ids"])) for r in got] == want


@pytest.mark.parametrize(
    ("op", "target", "content", "want", "reason"),
    [
        ("append", None, "new", "# A\none\n\n## B\ntwo\n\nnew\n\n" + REGION, ""),
        ("replace", "one", "1", "# A\n1\n\n## B\ntwo\n\n" + REGION, ""),
        ("delete", "one\n\n", None, "# A\n## B\ntwo\n\n" + REGION, ""),
        ("insert_after", "one", "more", "# A\none\n\nmore\n\n## B\ntwo\n\n" + REGION, ""),
        ("insert_after_section", "## B", "more", "# A\none\n\n## B\ntwo\n\nmore\n\n" + REGION, ""),
        ("replace", "keep", "x", None, "protected"),
        ("replace", "absent", "x", None, "target_not_found"),
        ("replace", None, "x", None, "no_target"),
        ("append", None, "  ", None, "empty_content"),
        ("rename", "one", "x", None, "unknown_op"),
    ],
)
def test_apply_edit(op, target, content, want, reason):
    doc = "# A\none\n\n## B\ntwo\n\n" + REGION
    assert markdown.apply_edit(doc, op, target, content) == (want if want is not None else doc, reason)


def test_fold_edits(spark):
    docs = spark.createDataFrame([("d", "a"), ("e", None)], "doc_id string, text string")
    todo = spark.createDataFrame(
        [("d", 2, "E2", "replace", "b", "c"), ("d", 1, "E1", "replace", "a", "b"), ("d", 3, "E3", "delete", "zzz", None)],
        "doc_id string, ord int, edit_id string, op string, target string, content string",
    )
    got = {r["doc_id"]: r for r in markdown.fold_edits(docs, todo).collect()}
    assert (got["d"]["text"], got["d"]["applied"], got["d"]["failed"]) == ("c", ["E1", "E2"], ["E3:target_not_found"])
    assert got["e"]["text"] == ""


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40), (5, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours_over_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(30)], "id long, v array<double>")
    a = {(r["id"], r["rn"]): r["neighbour"] for r in embed.top_neighbours(df, "id", "v", 3).collect()}
    b = {(r["id"], r["rn"]): r["neighbour"] for r in embed.top_neighbours(df, "id", "v", 3, block=7).collect()}
    assert a == b and len(a) == 90


def test_config(spark):
    a, b = config.config_table(spark, {"x": {"y": 1, "z": None}, "w": {}}), config.config_table(spark, {"x": {"y": 2}, "w": {}})
    assert {tuple(r) for r in config.differences(a, b).collect()} == {("x.y", "1", "2"), ("x.z", "null", None)}
    assert config.differences(a, b, {"x.z": "null"}).count() == 1
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert config.expand({"a": ["${X:-${Y}}", "${Z:-d}"]}, {"Y": "y", "X": ""}) is not None
    assert config.expand("${Z:-d}", {}) == "d"
    with pytest.raises(KeyError):
        config.expand("${Z}", {})
    assert config.redacted({"api_key": "k", "a": [{"token": ""}]}) == {"api_key": "<redacted>", "a": [{"token": "<redacted>"}]}


def test_sources(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"task_id": "a", "score": 1}\n\n  \n{"task_id": "b", "trajectory": [{"step": 1, "action": "go"}]}\n')
    rows = {r["task_id"]: r for r in records.read_jsonl(spark, str(lines), records.RESULT).collect()}
    assert rows["a"]["score"] == 1.0 and rows["b"]["trajectory"][0]["action"] == "go"
    torn = tmp_path / "torn.jsonl"
    torn.write_text('{"task_id": "a"}\n{"task_')
    good, bad = records.read_quarantined(spark, str(torn), records.RESULT)
    assert (good.count(), bad.count()) == (1, 1)
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(torn), records.RESULT).collect()
    cache = tmp_path / "cache.jsonl"
    cache.write_text('{"cache_key":"k","embedding":[1,2]}\nbad\n{"cache_key":"","embedding":[1]}\n{"cache_key":"k","embedding":[3,4]}\n{"cache_key":"q","embedding":["x"]}\n')
    found = embed.latest_cache(records.read_cache(spark, str(cache)), "ord").collect()
    assert [(r["cache_key"], r["embedding"]) for r in found] == [("k", [3.0, 4.0])]
    assert records.read_cache(spark, str(tmp_path / "none.jsonl")).count() == 0
    split = tmp_path / "split.txt"
    split.write_text("b_1\n\n a_2 \n")
    assert [tuple(r) for r in records.read_split_ids(spark, str(split)).orderBy("ord").collect()] == [("b_1", 0), ("a_2", 2)]
    split.write_text("b_1\nb_1\n")
    with pytest.raises(Exception, match="repeated id"):
        records.read_split_ids(spark, str(split)).collect()
    records.write_jsonl(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "out"))
    assert any('"y":null' in p.read_text() for p in (tmp_path / "out").glob("*.json"))
    records.save_json({"é": 1}, str(tmp_path / "deep/x.json"))
    assert json.loads((tmp_path / "deep/x.json").read_text()) == {"é": 1}
    doc = tmp_path / "s.md"
    doc.write_text("# A\n\nb")
    assert records.read_markdown(spark, str(doc)).first()["text"] == "# A\n\nb"
    with pytest.raises(Exception, match="changed"):
        records.read_pinned(spark, str(doc), {"s.md": "0" * 64}).collect()
    done = spark.createDataFrame([(1,)], "bundle int")
    assert [r[0] for r in records.completed(done, spark.createDataFrame([(1,), (2,)], "bundle int"), ["bundle"]).collect()] == [2]


def test_path_manifest(spark, tmp_path):
    for name in ("t1", "t2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "game.pddl").write_text("x")
    (tmp_path / "t1" / "traj.json").write_text('{"task_type": "clean"}')
    schema = records.struct("task_type string")
    got = records.read_path_manifest(spark, str(tmp_path), "game.pddl", "traj.json", schema, None).collect()
    assert [(r["gamefile"].rsplit("/", 2)[1], r["task_type"]) for r in got] == [("t1", "clean")]
    (tmp_path / "t2" / "traj.json").write_text('{"task_type": "pick_two_obj_and_place"}')
    got = records.read_path_manifest(spark, str(tmp_path), "game.pddl", "traj.json", schema).collect()
    assert [r["gamefile"].rsplit("/", 2)[1] for r in got] == ["t2"]


@pytest.mark.parametrize("least", [2_000, 0])
def test_components_with_a_hub_and_a_long_path(spark, monkeypatch, least):
    monkeypatch.setattr(graph, "LEAST_EDGES", least)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 180)] + [(300, 300), (None, 1), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 181)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_likely_members_loses_none(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("h"), "id")
    keys = rows.where("id % 10 = 0").select("h")
    kept = {r["id"] for r in membership.likely_members(rows, "h", keys, 200).collect()}
    assert kept >= set(range(0, 2000, 10)) and len(kept) < 600
    assert membership.likely_members(rows, "h", keys.limit(0), 0).count() == 0
    assert membership.likely_members(rows, "h", keys, 1 << 40).count() == 2000
