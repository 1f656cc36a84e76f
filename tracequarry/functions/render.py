"""Texts made from rows: histories, scores, edit summaries, memory inputs, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequarry.functions import text as X


def trimmed_number(value: Column, signed: bool = False) -> Column:
    """Four places at most, without trailing zeros."""
    out = F.regexp_replace(F.format_string("%+.4f" if signed else "%.4f", value.cast("double")), r"\.?0+$", "")
    return out if signed else X.or_else(out, F.lit("0"))


def score_text(value: Column) -> Column:
    return F.coalesce(trimmed_number(value), F.lit("unavailable"))


def _blank(s: Column, name: str) -> Column:
    return F.coalesce(s[name], F.lit(""))


def plain_history(steps: Column) -> Column:
    """One line per step; an observation only where there is one."""

    def line(s: Column, i: Column) -> Column:
        number = F.concat(F.lit("Step "), F.coalesce(s["step"], i).cast("string"), F.lit(": "))
        seen = F.when(_blank(s, "observation") != "", F.concat(F.lit("observation="), s["observation"], F.lit(" "))).otherwise("")
        return F.concat(number, seen, F.lit("action="), _blank(s, "action"))

    return F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, "None").otherwise(F.array_join(F.transform(steps, line), "\n"))


def bracketed_history(steps: Column) -> Column:
    """Observations and actions in brackets, counted from 1."""

    def line(s: Column, i: Column) -> Column:
        n = (F.coalesce(s["step"], i) + 1).cast("string")
        return F.concat(F.lit("[Observation "), n, F.lit(": '"), _blank(s, "observation"), F.lit("', Action "), n, F.lit(": '"), _blank(s, "action"), F.lit("']"))

    return F.array_join(F.transform(steps, line), "\n")


def scored_history(steps: Column) -> Column:
    """Steps as paragraphs with result and score change."""

    def paragraph(s: Column, i: Column) -> Column:
        known = s["score_before"].isNotNull() & s["score_after"].isNotNull() & s["score_delta"].isNotNull()
        change = F.concat(
            F.lit("Score: "), score_text(s["score_before"]), F.lit(" -> "), score_text(s["score_after"]), F.lit(" (delta "), trimmed_number(s["score_delta"], True), F.lit(")")
        )
        return F.concat_ws(
            "\n",
            F.concat(F.lit("Step "), F.coalesce(s["step"], i).cast("string")),
            F.concat(F.lit("Observation: "), _blank(s, "observation")),
            F.concat(F.lit("Action: "), _blank(s, "action")),
            F.concat(F.lit("Result: "), _blank(s, "next_observation")),
            F.when(known, change).otherwise("Score: unavailable"),
        )

    none = F.coalesce(F.size(steps), F.lit(0)) <= 0
    return F.when(none, "No previous steps.").otherwise(F.array_join(F.transform(steps, paragraph), "\n\n"))


def short_edits(edits: Column) -> Column:
    """Edits as 'op:content' of 80 code points each."""

    def item(e: Column) -> Column:
        said = X.or_else(e["content"], e["target"], F.lit(""))
        return F.concat(F.lower(_blank(e, "op")), F.lit(":"), F.substring(F.replace(F.coalesce(said, F.lit("")), F.lit("\n"), F.lit(" ")), 1, 80))

    return X.or_else(F.array_join(F.transform(edits, item), "; "), F.lit("no edits"))


def update_summary(edits: Column) -> Column:
    """Committed edits of an epoch, numbered."""
    # fixed values: the sentences of the summary
    none, head = "No skill edits were committed during this epoch.", "The following skill edits were committed during this epoch."

    def item(e: Column, i: Column) -> Column:
        target = X.or_else(F.coalesce(e["target"], F.lit("")), F.lit("null"))
        content = X.or_else(F.coalesce(e["content"], F.lit("")), F.lit("(empty)"))
        return F.concat((i + 1).cast("string"), F.lit(". op: "), _blank(e, "op"), F.lit("\ntarget: "), target, F.lit("\ncontent:\n"), content)

    text = F.concat(F.lit(head + "\n\n"), F.array_join(F.transform(edits, item), "\n\n"))
    return F.when(F.coalesce(F.size(edits), F.lit(0)) <= 0, none).otherwise(text)


def memory_input(before: Column, after: Column, memory: Column, summary: Column, comparison: Column) -> Column:
    """What the memory writer reads: five titled parts."""
    # fixed values: the titles, in order
    titles = ("Previous Epoch's Skill", "Current Epoch's Skill", "Previous Longitudinal Memory", "Skill Update Summary", "Longitudinal Comparison")
    kept = X.or_else(X.strip(F.coalesce(memory, F.lit(""))), F.lit("(No previous longitudinal memory.)"))
    parts = (before, after, kept, summary, comparison)
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"## {t}\n"), F.coalesce(p, F.lit(""))) for t, p in zip(titles, parts, strict=True)))


def document_source(mode: Column, none: tuple[str, ...], static: str, evolving: str) -> Column:
    """Where the document of a mode comes from."""
    return F.when(mode.isin(*none), "none").when(mode == static, "static_markdown").when(mode == evolving, "evolving_markdown").otherwise("unknown")


def reasoning_effort(model: Column, given: Column) -> Column:
    name = F.lower(F.coalesce(model, F.lit("")))
    return F.coalesce(F.nullif(given, F.lit("")), F.when(name.startswith("gpt-5") & name.contains("mini"), "medium"))


def retry_budget(status: Column, message: Column, budget: Column, least: int = 8, most: int = 256) -> Column:
    """Completion tokens that still fit, read from a context-length error; null where it says nothing.

    The three patterns must match the errors' wording.

    The safety margin is a sixteenth of what is free, within limits; a lower bound of the input
    also halves the budget.
    """
    text = F.coalesce(message, F.lit(""))

    def number(pattern: str) -> Column:
        return F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")).try_cast("long")

    limit = number(r"(?i)maximum context length is\s*([\d,]+)\s*tokens")
    used = F.coalesce(number(r"(?i)prompt contains(?: at least)?\s*([\d,]+)\s*input tokens"), number(r"(?i)parameter\s*=\s*input_tokens\s*,\s*value\s*=\s*([\d,]+)"))
    free = limit - used
    margin = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(free / 16)))
    budget = F.greatest(budget.cast("long"), F.lit(1))
    new = F.least(budget - 1, free - margin)
    bounded = F.regexp_like(text, F.lit(r"(?i)prompt contains\s+at least\s*[\d,]+\s*input tokens"))
    new = F.when(bounded, F.least(new, F.floor(budget / 2))).otherwise(new)
    said = (status == 400) & F.lower(text).contains("context length")
    return F.when(said & free.isNotNull() & (new >= 1), new)


# fixed values: what an error says of a prompt that is too long
TOO_LONG = ("context window", "context length", "maximum context")


def halved_budget(status: Column, message: Column, budget: Column, attempt: Column, least: int = 128, tries: int = 5) -> Column:
    """Half of the completion tokens, but ``least``, where an error says no numbers; null where that is no less, or after ``tries``."""
    text = F.lower(F.coalesce(message, F.lit("")))
    said = F.lit(False)
    for phrase in TOO_LONG:
        said = said | text.contains(phrase)
    now = F.greatest(F.lit(1), budget.cast("long"))
    half = F.greatest(F.lit(least), F.floor(now / 2))
    return F.when((status == 400) & said & (attempt < tries) & (half < now), half)


def unique_name(prefix: Column) -> Column:
    """A name that no other run has: not the same twice."""
    return F.concat_ws("_", prefix, F.replace(F.uuid(), F.lit("-"), F.lit("")))


def upserted(entries: Column, key: Column, value: Column) -> Column:
    """A map with one entry set; the key's former value goes."""
    return F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(key, value))
