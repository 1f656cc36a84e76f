"""Runtime settings of a run: projection with defaults, snapshots, and guards against drift.

All of this is one small mapping on the driver; differences are found by the (path, value) tables of
``config`` or, for two mappings in memory, by the same rules here.
"""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from tracequarry.operators.config import PLACEHOLDER, canonical, flatten, redacted
from tracequarry.sources.records import save_json

# fixed values: settings that every run has, with their defaults
COMMON = {
    "action_model": None,
    "action_llm_kind": "openai",
    "action_base_url": None,
    "action_proxy_url": None,
    "action_temperature": None,
    "action_max_new_tokens": 512,
    "action_load_in_4bit": False,
    "action_timeout": 180,
    "action_max_retries": -1,
    "action_retry_initial_sleep": 5.0,
    "action_retry_max_sleep": 60.0,
    "action_thinking": None,
    "action_reasoning_effort": "medium",
    "action_extra_body": None,
    "dry_run_action": False,
    "max_steps": 50,
    "parallel_workers": 1,
    "seed": 42,
    "top_k_general_skills": 5,
    "top_k_task_specific_skills": 2,
    "general_skill_retrieval_threshold": 0.0,
    "task_specific_skill_retrieval_threshold": 0.0,
    "task_specific_retrieval_scope": "detected",
}
# fixed values: names of settings whose argument is called otherwise
GIVEN_AS = {"action_extra_body": "action_extra_body_json", "parallel_workers": "bundle_size"}
# fixed values: variables of the process that stand in for a setting, first one set wins
FROM_PROCESS = {
    "action_base_url": ("ACTION_OPENAI_BASE_URL", "OPENAI_BASE_URL"),
    "action_proxy_url": ("ACTION_OPENAI_PROXY_URL", "OPENAI_PROXY_URL"),
}
# fixed values: files of an output folder that say nothing about a run
IDLE_FILES = (".generate.lock", "llm_context_config.json", "watch.log", "launcher.log")
ABSENT = ("", None)


def project(given: Mapping[str, Any], defaults: Mapping[str, Any] = COMMON, process: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The settings named by ``defaults``: as given, else from the process, else the default.

    Texts that hold JSON become what they hold, flags booleans, base addresses lose a final slash,
    and there is at least one worker.
    """
    process = process or {}
    out: dict[str, Any] = {}
    for name, default in defaults.items():
        value = given.get(GIVEN_AS.get(name, name))
        if value in ABSENT and name in FROM_PROCESS:
            value = next((process[v] for v in FROM_PROCESS[name] if process.get(v)), None)
        if isinstance(default, bool):
            value = bool(value)
        elif value is None or (value == "" and name != "action_model"):
            value = default
        out[name] = value
    if "action_base_url" in out and out["action_base_url"]:
        out["action_base_url"] = str(out["action_base_url"]).rstrip("/")
    if isinstance(body := out.get("action_extra_body"), str):
        try:
            out["action_extra_body"] = json.loads(body)
        except ValueError:
            pass
    if "parallel_workers" in out:
        out["parallel_workers"] = max(1, int(out["parallel_workers"] or 1))
    return out


def runtime(dataset: str, given: Mapping[str, Any], own: Mapping[str, Any], process: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Common settings and those of a benchmark; ``own`` holds the benchmark's settings with defaults."""
    return {"dataset": dataset.lower().replace("science_world", "scienceworld"), "common": project(given, COMMON, process), "dataset_runtime": project(given, own, process)}


def differing(expected: Any, actual: Any, defaults: Mapping[str, Any] | None = None) -> list[str]:
    """'path: expected, actual' for every setting that differs; defaults stand in for missing paths."""
    a, b = ({**(defaults or {}), **flatten(x)} for x in (expected, actual))
    missing = object()
    paths = sorted(p for p in {*a, *b} if canonical(a.get(p, missing), missing) != canonical(b.get(p, missing), missing))
    return [f"{p}: expected {a.get(p, '<missing>')!r}, found {b.get(p, '<missing>')!r}" for p in paths]


def guard(expected: Any, actual: Any, what: str, defaults: Mapping[str, Any] | None = None) -> None:
    """Fail if settings differ."""
    if found := differing(expected, actual, defaults):
        raise RuntimeError(f"{what} differs:\n  - " + "\n  - ".join(found))


def snapshot(path: str, current: dict, *, resume: bool, what: str = "runtime") -> dict:
    """The stored settings of a run that goes on, which must be the current ones; else the current ones, now stored."""
    if resume and Path(path).exists():
        stored = json.loads(Path(path).read_text(encoding="utf-8"))
        guard(stored, current, what)
        return stored
    save_json(current, path)
    return current


def context_guard(folder: str, full: bool) -> None:
    """A run keeps the context mode it began with; full context doesn't go on from a run without a mark."""
    path = Path(folder) / "llm_context_config.json"
    mark = {"schema_version": 1, "llm_full_context": full, "mode": "full_interactions_and_evidence" if full else "compacted_legacy"}
    if path.exists():
        try:
            stored = json.loads(path.read_text(encoding="utf-8"))
        except ValueError as e:
            raise RuntimeError(f"cannot read {path}") from e
        if not isinstance(stored, dict) or bool(stored.get("llm_full_context")) != full:
            raise RuntimeError(f"context mode differs: stored {stored!r}, wanted {mark!r}")
        return
    if full and Path(folder).is_dir() and any(f.name not in IDLE_FILES for f in Path(folder).iterdir()):
        raise RuntimeError("full context can't go on from a run without a context mark")
    save_json(mark, str(path))


def write_snapshot(folder: str, resolved: Any, command: Iterable[str]) -> None:
    """The resolved configuration without secrets, and the command as one shell line."""
    save_json(redacted(resolved), f"{folder}/resolved_config.json")
    Path(folder, "resolved_command.txt").write_text(shlex.join(list(command)) + "\n", encoding="utf-8")


def placeholders(arguments: Mapping[str, Any]) -> list[str]:
    """Names of the arguments that still hold a placeholder."""
    return [name for name, value in arguments.items() if isinstance(value, str) and re.search(PLACEHOLDER, value)]


def check_placeholders(arguments: Mapping[str, Any], allow: bool = False) -> None:
    if not allow and (bad := placeholders(arguments)):
        raise ValueError("placeholders left in: " + ", ".join(bad))


def resumed(folder: str, config: dict, files: tuple[str, ...] = ("results.json", "logs.json", "config.json"), enabled: bool = True) -> dict[str, Any] | None:
    """What a run left, by file name, if all its files are there and its configuration is the current one."""
    paths = [Path(folder, f) for f in files]
    if not enabled or not all(p.is_file() for p in paths):
        return None
    found = {p.name: json.loads(p.read_text(encoding="utf-8")) for p in paths}
    return found if not differing(found[files[-1]], config) else None


def evaluation_config(given: Mapping[str, Any], names: Iterable[str], current: dict) -> dict[str, Any]:
    """The named arguments of an evaluation and its runtime settings; what isn't given is null."""
    return {**{n: given.get(n) for n in names}, "action_runtime": current}


def save_checkpoint(path: str, task: Mapping[str, Any], status: str, trajectory: list[dict], result: dict | None = None, **facts: Any) -> None:
    """A task's checkpoint, written whole: its identity, where it stands and, when done, its result."""
    done = {"result": result} if result is not None else {}
    save_json({"schema_version": 1, "status": status, **task, **facts, "next_step": len(trajectory), "trajectory": trajectory, **done}, path)
