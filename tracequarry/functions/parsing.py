"""Structured output of models: JSON found in prose, typed contracts, code, recursive redaction.

The scans for a first decodable object and for code that compiles have no built-in form; they are
Arrow-batched functions. Nothing parsed is ever executed.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.text import BEARER, SECRET_KEY, SECRET_WORDS

ACTION = re.compile(r"<action>\s*(.*?)\s*</action>", re.I | re.S)
FENCES = (re.compile(r"```(?:python|py)\s*\n?(.*?)```", re.I | re.S), re.compile(r"```(?:python|py)\s*\n?(.*)\Z", re.I | re.S))
KEY = re.compile(SECRET_KEY, re.I)
QUOTED = re.compile(rf"(?i)(\b(?:[a-z0-9_]*(?:{SECRET_WORDS})[a-z0-9_]*)\b\s*(?::|=)\s*)(['\"])(.*?)(\2)")
TOKEN = re.compile(BEARER)
DECODER = json.JSONDecoder()
_EDIT = "op:string,target:string,content:string"
_CITED = f"array<struct<{_EDIT},evidence_ids:array<string>>>"
_FOUND = f"struct<pattern:string,proposed_edit:struct<{_EDIT}>,trigger_range:struct<task_id:string,start:int,`end`:int>>"
# fixed values: what a contract may say
CONTRACTS = {
    "judge": "decision string, reason string",
    "extractor": f"evidence array<struct<experience_type:string,failure_type:string,pattern:string,proposed_edit:struct<{_EDIT}>,trigger_ranges:array<struct<task_id:string,start:int,`end`:int>>>>",
    "merger": f"reasoning string, omitted_evidence array<struct<evidence_id:string,reason:string>>, edits {_CITED}",
    "edit_judge": "decision string, replay_failure_type string, reason string",
    "reflector": f"reason string, revised_edit struct<{_EDIT},evidence_ids:array<string>>",
    "epoch_merger": f"reasoning string, omitted_source_edits array<struct<candidate_edit_id:string,reason:string>>, merged_edits array<struct<{_EDIT},evidence_ids:array<string>,source_edit_ids:array<string>>>",
    "repair": f"reasoning string, omitted_evidence array<struct<evidence_id:string,reason:string>>, repair_edits {_CITED}",
    "ranker": "selected_edit_ids array<string>, dropped_edit_ids array<string>",
    "coverage": "coverage array<struct<evidence_id:string,decision:string,reason:string>>",
    "memory": "reasoning string, longitudinal_memory_content string",
    "feedback": "feedback string",
    "contrast_judge": f"decision string, failure_type string, reason string, evidence {_FOUND}",
    "epoch_judge": f"decision string, failure_type string, reason string, evidence {_FOUND}",
}
# fixed values: the words that a decision may be
DECISIONS = {
    "judge": ("keep", "drop"),
    "edit_judge": ("accept", "reflect", "reject"),
    "contrast_judge": ("support", "evidence", "no_evidence"),
    "epoch_judge": ("evidence", "no_evidence"),
}
# fixed values: how a replayed edit failed, and the decision that goes with it
FAILURE_DECISION = {"rule_ignored": "accept", "rule_missing": "reflect", "rule_wrong": "reflect"}
# fixed values: the ops of an edit
EDIT_OPS = ("append", "insert_after", "insert_after_section", "replace", "delete")
# fixed values: what is run where a text holds no code
FALLBACK_CODE = "print(apis.api_docs.show_app_descriptions())"


#: Objects nested deeper than this count as no objects, with all that they hold.
DEEPEST = 400
#: What an object may begin with; all else can't decode.
BEGINNING = re.compile(r'\{\s*(?:\}|"(?:[^"\\]|\\.)*"\s*:)', re.S)
MARKS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)


def nesting(text: str, at: int, end: int) -> tuple[int, int, set[int]]:
    """(greatest depth, place behind the value that begins at ``at``, or ``end``, objects still open at ``end``)."""
    deepest, open_ = 0, []
    for m in MARKS.finditer(text, at, end):
        mark = m[0][0]
        if mark in "{[":
            open_.append(m.start() if mark == "{" else -1)
            deepest = max(deepest, len(open_))
        elif mark in "}]" and open_:
            open_.pop()
            if not open_:
                return deepest, m.end(), set()
    return deepest, end, set(open_)


def first_object(text: str | None) -> str | None:
    """JSON of the text, else of the first place from which an object decodes; None if there is none.

    An object that is open where decoding fails can't decode from its own place either, so those places
    aren't tried again: the time grows with the text, however many braces it has.
    """
    text = re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", (text or "").strip())
    if nesting(text, 0, len(text))[0] <= DEEPEST:
        try:
            value = json.loads(text)
            return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
        except ValueError:
            pass
    at, hopeless = text.find("{"), set()
    while at >= 0:
        if at not in hopeless and BEGINNING.match(text, at):
            try:
                value, _ = DECODER.raw_decode(text, at)
                return json.dumps(value, ensure_ascii=False)
            except ValueError as e:
                hopeless |= nesting(text, at, getattr(e, "pos", len(text)))[2]
            except RecursionError:
                # too deep, and so are the objects around its innermost ones: go on behind it
                at = max(at, nesting(text, at, len(text))[1] - 1)
        at = text.find("{", at + 1)
    return None


def code_of(text: str | None, fallback: str = FALLBACK_CODE) -> str:
    """Code of an action: in a Python fence, ended or not, in a JSON field, or the text itself if it compiles."""
    text = (text or "").strip()
    if m := ACTION.search(text):
        text = m[1].strip()
    for fence in FENCES:
        if (m := fence.search(text)) and m[1].strip():
            return m[1].strip()
    if (found := first_object(text)) and (code := str(json.loads(found).get("code") or "").strip()):
        return code
    try:
        compile(text, "<text>", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return fallback
    return text or fallback


def redact_value(value):
    """Secrets hidden at any depth; texts that hold JSON are parsed and written back."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if KEY.search(str(k)) and v not in (None, "") else redact_value(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_value(v) for v in value]
    if not isinstance(value, str):
        return value
    if value.strip()[:1] in ("{", "["):
        try:
            return json.dumps(redact_value(json.loads(value)), ensure_ascii=False, indent=1)
        except (ValueError, RecursionError):  # no JSON, or nested too deep to be taken apart: hidden as plain text
            pass
    return TOKEN.sub("Bearer [REDACTED]", QUOTED.sub(r"\1\2[REDACTED]\4", value))


def column_of(function, kind: str = "string"):
    """A text function as a column function."""

    @F.pandas_udf(kind)
    def batched(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action=None)

    return batched


def parse_contract(rows: DataFrame, text: Column, role: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the typed fields of the role in ``parsed``, rows whose text holds no object)."""
    found = rows.withColumn("__json", column_of(first_object)(text))
    good = found.where(F.col("__json").isNotNull())
    return good.withColumn("parsed", F.from_json("__json", CONTRACTS[role])).drop("__json"), found.where(F.col("__json").isNull()).drop("__json")


def accepted(parsed: DataFrame, role: str, field: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """(rows that keep the role's rules, the others).

    A decision is one of the role's words. What an edit judge says of a failure goes with its decision;
    without a failure it accepts or rejects. A revised edit has a known op and cites a card.
    """
    p = F.col(field)
    good = F.lit(True)
    if role in DECISIONS:
        good = good & F.lower(p["decision"]).isin(*DECISIONS[role])
    if role == "edit_judge":
        failure = F.nullif(F.lower(F.coalesce(p["replay_failure_type"], F.lit(""))), F.lit("null"))
        wanted = F.try_element_at(F.create_map(*(F.lit(x) for kv in FAILURE_DECISION.items() for x in kv)), failure)
        free = F.coalesce(failure, F.lit("")) == ""
        good = good & F.when(free, F.lower(p["decision"]).isin("accept", "reject")).otherwise(F.coalesce(F.lower(p["decision"]) == wanted, F.lit(False)))
    if role == "reflector":
        e = p["revised_edit"]
        good = good & (e.isNull() | (F.lower(e["op"]).isin(*EDIT_OPS) & (F.size(e["evidence_ids"]) > 0)))
    good = F.coalesce(good, F.lit(False))
    return parsed.where(good), parsed.where(~good)


def items_of(parsed: DataFrame, key: str, field: str) -> DataFrame:
    """(key, ord, fields of each item of a list): drafts, patches, omissions; empty and null items go."""
    rows = parsed.select(key, F.posexplode(F.col(f"parsed.{field}")).alias("ord", "item"))
    return rows.where(F.col("item").isNotNull()).select(key, "ord", "item.*")


def normal_edits(edits: DataFrame) -> DataFrame:
    """Edits with a known op, in lower case; of those but append the target must say something, of those but delete the content."""
    op = F.lower(F.btrim("op"))
    rows = edits.withColumn("op", op).where(F.col("op").isin(*EDIT_OPS))
    said = {c: F.btrim(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("target", "content")}
    return rows.where(((F.col("op") == "append") | said["target"]) & ((F.col("op") == "delete") | said["content"]))


def response_error(response: Column) -> Column:
    """What a chat response says instead of an answer: its error's message, else that it has no text."""
    v = F.try_parse_json(response)
    message = F.coalesce(F.try_variant_get(v, "$.error.message", "string"), F.try_variant_get(v, "$.error", "string"))
    return F.when(choice_text(response).isNull(), F.coalesce(F.nullif(message, F.lit("")), F.lit("response without text")))


def choice_text(response: Column) -> Column:
    """Text of a chat response in JSON: content, its parts joined, reasoning, refusal, or plain text."""
    v = F.try_parse_json(response)

    def at(path: str) -> Column:
        return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))

    parts = F.try_variant_get(v, "$.choices[0].message.content", "array<struct<type:string,text:string>>")
    joined = F.nullif(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit(""))
    plain = F.when(parts.isNull(), at("$.choices[0].message.content"))
    return F.coalesce(joined, plain, at("$.choices[0].message.reasoning_content"), at("$.choices[0].message.refusal"), at("$.choices[0].text"))
