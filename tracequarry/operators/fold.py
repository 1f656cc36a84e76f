"""Folds over large ordered groups: a group's rows stream through one task, which keeps its state alone.

Rows are dealt by group and sorted within partitions, which Spark does on disk where it must. A task then
meets each group's rows in order, whatever the batches, and what it keeps doesn't grow with them. A hash of
ordered lines can't be taken in parts, so a group is one task's work, but not one task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_groups(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows so dealt and sorted that a partition meets each of its groups in one run, in order."""
    return (rows.repartition(*by) if by else rows.coalesce(1)).sortWithinPartitions(*by, *order)


def fingerprint(rows: DataFrame, line: Column, order: list[str], by: list[str]) -> DataFrame:
    """(by, n, fingerprint): SHA-256 of each group's lines in order, joined by newlines; null lines are left out, but count."""
    named = rows.select(*by, *order, line.cast("string").alias("__line"))
    kinds = [named.schema[c] for c in by]
    out = ", ".join([*(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds), "n bigint, fingerprint string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        n, said, state = 0, False, hashlib.sha256()

        def told(batch_schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([v], batch_schema.field(c).type) for c, v in zip(by, now, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n], pa.int64()), pa.array([state.hexdigest()])], [*by, "n", "fingerprint"])

        schema = None
        for batch in batches:
            schema = batch.schema
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            for key, text in zip(keys, batch.column("__line").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield told(schema)
                    now, n, said, state = key, 0, False, hashlib.sha256()
                n += 1
                if text is not None:
                    state.update(("\n" + text if said else text).encode())
                    said = True
        if now is not None:
            yield told(schema)

    return in_groups(named, by, order).mapInArrow(run, out)


def folded(rows: DataFrame, by: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], None], end: Callable[[Any, Any], list[tuple]], out: str) -> DataFrame:
    """Rows that ``end`` gives for each group, after ``step`` has met its rows in order, one by one."""
    names = [c.strip().split(" ")[0].strip("`") for c in out.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, met = None, None, False
        for pdf in batches:
            made: list[tuple] = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                key = getattr(row, by)
                if not met or key != now:
                    if met:
                        made += end(now, state)
                    now, state, met = key, start(), True
                step(state, row)
            yield pd.DataFrame(made, columns=names)
        if met:
            yield pd.DataFrame(end(now, state), columns=names)

    return in_groups(rows, [by], order).mapInPandas(run, out)
