"""Injected rollouts, replays, the branch document and configuration profiles."""

import json

import pytest

from tracequarry.operators import config, rollout, runtime, state


class Counting:
    """Score grows with each 'go'; 'boom' fails."""

    def __init__(self, task):
        self.n, self.goal = 0, task.get("goal") or 3

    def reset(self, task):
        if task.get("task_id") == "boom":
            raise RuntimeError("no server")
        return "at 0", {"valid": ["go", "stay"]}

    def step(self, action):
        self.n += action == "go"
        return f"at {self.n}", self.n / self.goal, self.n >= self.goal, {"admissible_actions": [["go", "stay"]]}


def test_run_tasks(spark):
    tasks = spark.createDataFrame([("a", 3), ("b", 99), ("boom", 1)], "task_id string, goal int")
    got = {r["task_id"]: r for r in rollout.run_tasks(tasks, Counting, rollout.FirstActionAgent, max_steps=5).collect()}
    assert (got["a"]["success"], got["a"]["steps"], got["a"]["score"]) == (True, 3, 1.0)
    assert (got["b"]["success"], got["b"]["steps"]) == (False, 5)
    assert not got["boom"]["ok"] and "no server" in got["boom"]["error"]
    assert [s["score_delta"] for s in got["a"]["trajectory"]][0] is None
    assert got["a"]["trajectory"][1]["score_delta"] == pytest.approx(1 / 3)


def test_replay_goes_on_from_the_prefix():
    recorded = [{"step": i, "action": a} for i, a in enumerate(["go", "stay", "go", "go"])]
    loop = rollout.Loop(Counting({"goal": 9}), rollout.FirstActionAgent())
    got = loop.run({}, replay=recorded, start=2, steps=2)
    assert got["prefix_actions"] == ["go", "stay"]
    assert [s["step"] for s in got["trajectory"]] == [0, 1, 2, 3]
    assert got["trajectory"][1]["bad_step"] and not got["trajectory"][2]["bad_step"]


def test_recorded_environment():
    steps = [{"action": "a", "observation": "x", "next_observation": "y", "score_after": 0.5}, {"action": "b", "observation": "y", "next_observation": "z", "score_after": 1.0}]
    got = rollout.Loop(rollout.RecordedEnvironment(steps), rollout.FirstActionAgent()).run({})
    assert got["success"] and got["steps"] == 2
    assert rollout.RecordedEnvironment([]).reset({})[0] == ""


def test_branch_state(tmp_path):
    s = state.new_state("A", "doc")
    assert state.problems(s, dataset="a", validated="doc", working="doc", policy=state.POLICY, replay_mode="standard") == []
    assert state.advance(s, "working", "doc2") == "W0001"
    assert len(state.problems(s, dataset="b", validated="doc", working="doc")) == 2
    path = str(tmp_path / "s/state.json")
    state.save(s, path)
    assert state.load(path) == s
    (tmp_path / "s/state.json").write_text("{")
    assert state.load(path) is None and (tmp_path / "s/state.json.corrupt").exists()
    assert state.load(path) is None
    assert state.problems([], dataset="a", validated="", working="") == ["not an object"]
    assert len(state.problems({**s, "enabled": False, "mode": "x", "evidence_version": 0}, dataset="a", validated="doc", working="doc2")) == 3


def test_checkpoints_of_tasks(spark):
    tasks = spark.createDataFrame([("t", "f", "x", 2), ("u", None, "x", 1)], "task_id string, gamefile string, mode string, bundle int")
    stored = [("t", "f", "x", 2, "a"), ("t", None, "x", None, "b"), ("t", "f", "y", 2, "c"), ("t", "g", "x", 2, "d"), ("u", "z", "x", 1, "e"), ("v", None, "x", 1, "f")]
    got = state.matching_checkpoints(tasks, spark.createDataFrame(stored, "task_id string, gamefile string, mode string, bundle int, result string"))
    assert sorted(r["checkpoint_result"] for r in got.collect()) == ["a", "b", "e"] and got.columns == [*tasks.columns, "checkpoint_result"]
    filled = state.with_defaults(spark.createDataFrame([(1, None)], "evidence_id int, rejects int")).first()
    assert (filled["rejects"], filled["l2_status"], filled["support_count"], filled["archived"]) == (0, "active", 1, False)


def test_actions_meant():
    known = ["go north", "open the door", "look"]
    assert rollout.meant_action("Open  the DOOR", known) == "open the door"
    assert rollout.meant_action("please open the door now", known) == "open the door"
    assert rollout.meant_action("look and go north", known) == "look and go north"
    assert rollout.meant_action("jump", known) == "jump" and rollout.meant_action(" x ", []) == "x"


def test_search_and_documents():
    class Shuffling:
        def __init__(self):
            self.n = 0

        def reset(self, task):
            self.n += 1
            return f"Task {self.n}.", {}

    assert rollout.search_environment(Shuffling(), "task  5")[0] == "Task 5."
    with pytest.raises(LookupError):
        rollout.search_environment(Shuffling(), "other", 9)
    given = rollout.DocumentProvider("whole text", "d")
    found = given.retrieve("q", extra=1)
    assert given.format_for_prompt(found) == "whole text" and given.retrieved_ids(found) == ["d"] and given.version == 0


def test_runtime_settings(tmp_path):
    got = runtime.runtime("Science_World", {"bundle_size": 0, "action_base_url": "", "action_extra_body_json": '{"a": 1}', "dry_run_action": None}, {"env_timeout": 180}, {"OPENAI_BASE_URL": "http://x/"})
    assert got["dataset"] == "scienceworld" and got["dataset_runtime"] == {"env_timeout": 180}
    c = got["common"]
    assert (c["parallel_workers"], c["action_base_url"], c["action_extra_body"], c["dry_run_action"], c["seed"]) == (1, "http://x", {"a": 1}, False, 42)
    path = str(tmp_path / "r" / "runtime.json")
    assert runtime.snapshot(path, got, resume=True) == got
    runtime.snapshot(path, {**got, "common": {**c, "action_timeout": 180.0}}, resume=True)
    with pytest.raises(RuntimeError, match="common.seed"):
        runtime.snapshot(path, {**got, "common": {**c, "seed": 1}}, resume=True)
    assert runtime.differing({"a": {}}, {}) == [] and runtime.differing({"a": None}, {}) != [] and runtime.differing({}, {"a": 1}, {"a": 1}) == []


def test_guards_and_files(tmp_path):
    assert runtime.placeholders({"a": "/path/to/x", "b": "x/your/y", "c": "/data/paths/z", "d": 1}) == ["a", "b"]
    with pytest.raises(ValueError, match="a"):
        runtime.check_placeholders({"a": "replace-me"})
    runtime.check_placeholders({"a": "replace-me"}, allow=True)
    runtime.context_guard(str(tmp_path / "new"), True)
    runtime.context_guard(str(tmp_path / "new"), True)
    with pytest.raises(RuntimeError):
        runtime.context_guard(str(tmp_path / "new"), False)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "results.json").write_text("[1]")
    with pytest.raises(RuntimeError):
        runtime.context_guard(str(tmp_path / "old"), True)
    assert runtime.resumed(str(tmp_path / "old"), {}) is None
    (tmp_path / "old" / "logs.json").write_text("[]")
    (tmp_path / "old" / "config.json").write_text('{"a": 1}')
    assert runtime.resumed(str(tmp_path / "old"), {"a": 1.0})["results.json"] == [1]
    assert runtime.resumed(str(tmp_path / "old"), {"a": 2}) is None and runtime.resumed(str(tmp_path / "old"), {"a": 1}, enabled=False) is None
    runtime.write_snapshot(str(tmp_path / "s"), {"api_key": "", "x": [{"token": 1}]}, ["run", "a b"])
    assert json.loads((tmp_path / "s" / "resolved_config.json").read_text()) == {"api_key": "<redacted>", "x": [{"token": "<redacted>"}]}
    assert (tmp_path / "s" / "resolved_command.txt").read_text() == "run 'a b'\n"
    runtime.save_checkpoint(str(tmp_path / "c.json"), {"task_id": "t"}, "running", [{"step": 0}], done=False)
    assert json.loads((tmp_path / "c.json").read_text())["next_step"] == 1
    assert runtime.evaluation_config({"a": 1}, ["a", "b"], {"r": 1}) == {"a": 1, "b": None, "action_runtime": {"r": 1}}
    (tmp_path / "c.yaml").write_text("a: {b: 1}\n")
    assert config.read_yaml(str(tmp_path / "c.yaml")) == {"a": {"b": 1}}


def test_profiles(spark):
    raw = {
        "environment": {"ROOT": "${BASE:-/data}/x"},
        "defaults": {"arguments": {"model": "m", "epochs": 4}, "watcher": {"restarts": 0}},
        "paths": {"data": "${ROOT}/d"},
        "profiles": {"p": {"arguments": {"epochs": 2}}, "bad": {"arguments": {"action_api_key": "k"}}},
    }
    got = config.resolve_profile(raw, "p", {})
    assert got["arguments"] == {"model": "m", "epochs": 2, "data": "/data/x/d"} and got["watcher"] == {"restarts": 0}
    with pytest.raises(ValueError, match="unknown profile"):
        config.resolve_profile(raw, "q", {})
    with pytest.raises(ValueError, match="process environment"):
        config.resolve_profile(raw, "bad", {})
    with pytest.raises(ValueError, match="secret"):
        config.resolve_profile({**raw, "environment": {"API_KEY": "x"}}, "p", {})
    roles = config.role_table(spark, {"judge": "j", "merger": "m"}, {"a": {}, "b": {"judge": "own"}})
    assert {tuple(r) for r in roles.collect()} == {("a", "judge", "j"), ("a", "merger", "m"), ("b", "judge", "own"), ("b", "merger", "m")}
