"""Running tasks in parallel with injected environments, agents and document providers.

Environments are live processes and can't be declared as a plan, so a task's loop runs in an
Arrow-batched Python function, one task after the other in each partition. Everything the loop
needs is given by factories that are called on the executors. Errors of a task become rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

STEPS = (
    "array<struct<step:int,observation:string,thought:string,action:string,next_observation:string,"
    "score_before:double,score_after:double,score_delta:double,done:boolean,bad_step:boolean>>"
)
RESULT = f"task_id string, ok boolean, success boolean, score double, steps int, trajectory {STEPS}, prefix_actions array<string>, error string"


class Environment(Protocol):
    def reset(self, task: dict) -> tuple[str, dict]: ...

    def step(self, action: str) -> tuple[str, float | None, bool, dict]: ...


class Agent(Protocol):
    def act(self, task: str, context: dict, document: str, history: list[dict], step: int) -> dict: ...


@dataclass
class RecordedEnvironment:
    """Answers from a recorded trajectory; an action that wasn't taken there changes nothing."""

    steps: list[dict]
    at: int = 0

    def reset(self, task: dict) -> tuple[str, dict]:
        self.at = 0
        return (self.steps[0].get("observation") or "" if self.steps else ""), self.info()

    def info(self) -> dict:
        return {"admissible_actions": [self.steps[self.at]["action"]] if self.at < len(self.steps) else []}

    def step(self, action: str) -> tuple[str, float | None, bool, dict]:
        if self.at >= len(self.steps) or self.steps[self.at]["action"] != action:
            seen = self.steps[min(self.at, len(self.steps) - 1)].get("observation") if self.steps else ""
            return seen or "", None, False, self.info()
        row = self.steps[self.at]
        self.at += 1
        return row.get("next_observation") or "", row.get("score_after"), self.at == len(self.steps), self.info()


@dataclass
class DocumentProvider:
    """Gives one whole document to every task."""

    text: str
    document_id: str = "document"
    version: int = 0

    def retrieve(self, query: str = "", **_: Any) -> dict:
        return {"document_ids": [self.document_id], "query": query}

    def format_for_prompt(self, retrieved: dict) -> str:
        return self.text if retrieved.get("document_ids") else ""

    def retrieved_ids(self, retrieved: dict) -> list[str]:
        return list(retrieved.get("document_ids") or [])


class FirstActionAgent:
    """Takes the first admissible action: a deterministic stand-in for a model."""

    def act(self, task: str, context: dict, document: str, history: list[dict], step: int) -> dict:
        known = context.get("admissible_actions") or []
        return {"thought": "first admissible action", "action": known[0] if known else ""}


def admissible(info: dict) -> list[str]:
    """Actions that the environment offers: the first list under a known name, a batch of one unwrapped."""
    for name in ("valid", "admissible_actions", "valid_actions", "available_actions"):
        found = info.get(name)
        if isinstance(found, (list, tuple)):
            return [str(a) for a in (found[0] if len(found) == 1 and isinstance(found[0], (list, tuple)) else found)]
    return []


def meant_action(said: str, known: list[str]) -> str:
    """The admissible action meant: the same, alike but for case and spaces, or the only one named; else what was said."""
    said, known = said.strip(), [a.strip() for a in known if a.strip()]
    plain = {" ".join(a.split()).lower(): a for a in reversed(known)}
    named = [a for a in known if a.lower() in said.lower()]
    if said in known or not known:
        return said
    return plain.get(" ".join(said.split()).lower()) or (named[0] if len(named) == 1 else said)


def search_environment(env: Environment, wanted: str, most: int = 512) -> tuple[str, dict]:
    """Reset until the environment offers the wanted instruction; an error after ``most`` resets."""

    def plain(text: str) -> str:
        return " ".join((text or "").lower().split()).removesuffix(".")

    for _ in range(most):
        seen, info = env.reset({})
        if plain(info.get("instruction") or seen) == plain(wanted):
            return seen, info
    raise LookupError(f"no task {wanted!r} in {most} resets")


@dataclass
class Loop:
    """One task's loop: replay recorded actions, then let the agent go on."""

    env: Environment
    agent: Agent
    max_steps: int = 50
    history: int = 8
    idle: str = "look around"
    bad_step: Callable[[str, str, str], bool] = lambda before, after, action: before.strip() == after.strip()
    trajectory: list[dict] = field(default_factory=list)

    def run(self, task: dict, document: str = "", replay: list[dict] = (), start: int = 0, steps: int | None = None) -> dict:
        self.trajectory = []
        seen, info = self.env.reset(task)
        score, done = None, False

        def go(number: int, thought: str, action: str) -> None:
            nonlocal seen, info, score, done
            before, shown = score, seen
            seen, after, done, info = self.env.step(action)
            score = after if after is not None else score
            delta = round(after - before, 10) if after is not None and before is not None else None
            self.trajectory.append(
                {
                    "step": number, "observation": shown, "thought": thought, "action": action, "next_observation": seen,
                    "score_before": before, "score_after": after, "score_delta": delta, "done": done, "bad_step": self.bad_step(shown, seen, action),
                }
            )

        prefix = [s for s in replay if int(s.get("step") or 0) < start]
        for s in prefix:
            if done:
                break
            go(int(s.get("step") or 0), "", s.get("action") or "")
        first = start if prefix else 0
        for number in range(first, first + min(self.max_steps - first, self.max_steps if steps is None else steps)):
            if done:
                break
            known = admissible(info)
            context = {"observation": seen, "admissible_actions": known, "current_score": score, "max_steps": self.max_steps}
            said = self.agent.act(task.get("instruction") or "", context, document, self.trajectory[-self.history :] if self.history else [], number)
            action = said.get("action") or self.idle
            go(number, said.get("thought") or "", meant_action(action, known))
        return {
            "success": bool(done and (score or 0) > 0), "score": float(score or 0), "steps": len(self.trajectory),
            "trajectory": self.trajectory, "prefix_actions": [s.get("action") or "" for s in prefix],
        }


def run_tasks(tasks: DataFrame, make_env: Callable[[dict], Environment], make_agent: Callable[[], Agent], *, document: str = "", partitions: int = 4, **loop: Any) -> DataFrame:
    """One result row per task; ``tasks`` needs task_id, and for replays replay, start_step and continue_steps.

    Tasks are dealt round robin over ``partitions``, the tasks in flight. A failing task gives a row
    with ok false and the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for task in json.loads(pdf.to_json(orient="records")):
                row: dict[str, Any] = {"task_id": task["task_id"], "ok": True, "error": None}
                try:
                    made = Loop(make_env(task), make_agent(), **loop)
                    row |= made.run(task, document, task.get("replay") or [], int(task.get("start_step") or 0), task.get("continue_steps"))
                except Exception as e:  # noqa: BLE001 - an error is a result here
                    row |= {"ok": False, "success": False, "score": 0.0, "steps": 0, "trajectory": [], "prefix_actions": [], "error": f"{type(e).__name__}: {e}"}
                yield pd.DataFrame([row])

    return tasks.repartition(partitions).mapInPandas(run, RESULT)
