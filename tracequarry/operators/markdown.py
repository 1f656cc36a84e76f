"""Applying edits to Markdown documents, one after the other, and folding many documents at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.text import REGION_END, REGION_START
from tracequarry.operators import fold

OPS = ("append", "insert_after", "insert_after_section", "replace", "delete")


def protected(doc: str, target: str) -> bool:
    """Whether the first occurrence of the target lies in the protected region."""
    start, end, at = doc.find(REGION_START), doc.find(REGION_END), doc.find(target)
    return bool(target) and -1 < start <= at < end + len(REGION_END)


def append(doc: str, content: str) -> str:
    head, mark, tail = doc.partition(REGION_START)
    lead = head.rstrip() + "\n\n" + content.strip()
    return lead + ("\n\n" + mark + tail if mark else "\n")


def section_end(doc: str, at: int) -> int:
    """Where the section of a heading ends: before the next heading of its level or above."""
    line = doc[doc.rfind("\n", 0, at) + 1 :]
    level = len(line) - len(line.lstrip("#")) or 6
    found = re.compile(rf"^#{{1,{level}}}\s", re.M).search(doc, doc.find("\n", at) if "\n" in doc[at:] else len(doc))
    guard = doc.find(REGION_START)
    end = found.start() if found else len(doc)
    return min(end, guard) if guard > at else end


def apply_edit(doc: str, op: str | None, target: str | None, content: str | None) -> tuple[str, str]:
    """(document, reason): reason is '' if the edit was applied, else why not.

    Targets must occur exactly; the first occurrence counts. Nothing inside the protected region
    is touched.
    """
    op, target, content = (op or "").strip().lower(), target or "", content or ""
    if op not in OPS:
        return doc, "unknown_op"
    if op != "delete" and not content.strip():
        return doc, "empty_content"
    if op == "append":
        return append(doc, content), ""
    if not target:
        return doc, "no_target"
    if (at := doc.find(target)) < 0:
        return doc, "target_not_found"
    if protected(doc, target):
        return doc, "protected"
    if op == "replace":
        return doc[:at] + content + doc[at + len(target) :], ""
    if op == "delete":
        return doc[:at] + doc[at + len(target) :], ""
    cut = at + len(target) if op == "insert_after" else section_end(doc, at)
    return doc[:cut].rstrip("\n") + "\n\n" + content.strip() + "\n" + ("\n" + doc[cut:].lstrip("\n") if doc[cut:].strip() else ""), ""


def apply_all(doc: str, edits: list[dict]) -> tuple[str, list[str]]:
    """(document, reasons): all edits in order, or, if one can't be applied, the document as it was."""
    now, reasons = doc, []
    for e in edits:
        now, reason = apply_edit(now, e.get("op"), e.get("target"), e.get("content"))
        reasons.append(reason)
    return (doc if any(reasons) else now), reasons


def fold_edits(documents: DataFrame, edits: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(key, text, applied, failed): each document with its edits applied in order; failures don't stop.

    With ``whole`` one failure leaves the document as it was. ``edits`` needs the key, ord, edit_id, op,
    target and content. A document's edits stream through a fold, which keeps the document and the ids;
    rows with one key are documents of their own, each with all edits. Edits without a document are lost.
    """
    none = {c: F.lit(None).cast(t) for c, t in {"name": "string", "op": "string", "target": "string", "content": "string"}.items()}
    orders = {c: edits.schema[c].dataType for c in ("ord", "edit_id")}
    given = documents.select(F.col(key).alias("k"), F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in orders.items()), *(v.alias(c) for c, v in none.items()), F.col(text).alias("doc"))
    wanted = edits.select(F.col(key).alias("k"), F.lit(1).alias("kind"), "ord", "edit_id", F.col("edit_id").cast("string").alias("name"), "op", "target", "content", F.lit(None).cast("string").alias("doc"))

    def step(docs: list, row) -> None:
        if not row.kind:
            docs.append([row.doc or "", row.doc or "", [], []])
            return
        for d in docs:
            d[0], reason = apply_edit(d[0], row.op, row.target, row.content)
            (d[3] if reason else d[2]).append(f"{row.name}:{reason}" if reason else row.name)

    def end(k, docs: list) -> list[tuple]:
        return [(k, before, [], failed) if whole and failed else (k, now, applied, failed) for now, before, applied, failed in docs]

    schema = f"k {documents.schema[key].dataType.simpleString()}, {text} string, applied array<string>, failed array<string>"
    made = fold.folded(given.unionByName(wanted), "k", ["kind", "ord", "edit_id"], list, step, end, schema)
    return made.withColumnRenamed("k", key)
