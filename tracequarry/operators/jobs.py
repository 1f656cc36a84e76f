"""Replay jobs as a table function of SQL: ``SELECT * FROM replay_jobs(TABLE(spans))``.

The function asks Spark for its input by edit and in the order of jobs, so a call needs to say neither,
and it numbers an edit's jobs while they stream through; it keeps one count.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

NEEDED = ("edit_id", "task_id", "task_family", "evidence_id", "start", "end", "support_count", "at", "nth")


class ReplayJobs:
    """Jobs of each edit, best supported first. Input is what ``ledger.job_spans`` gives; its types are kept."""

    def __init__(self) -> None:
        self.jobs = 0

    @staticmethod
    def analyze(spans: AnalyzeArgument) -> AnalyzeResult:
        if not spans.isTable:
            raise ValueError("replay_jobs takes a table")
        fields = {f.name: f for f in spans.dataType.fields}
        if missing := [c for c in NEEDED if c not in fields]:
            raise ValueError(f"replay_jobs lacks {', '.join(missing)}")
        out = T.StructType([fields[c] for c in NEEDED[:-2]]).add("rn", T.IntegerType())
        order = [OrderingColumn("support_count", ascending=False), *(OrderingColumn(c) for c in ("task_family", "task_id", "at", "nth"))]
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("edit_id")], orderBy=order)

    def eval(self, row: Row) -> Iterator[tuple]:
        self.jobs += 1
        yield (*(row[c] for c in NEEDED[:-2]), self.jobs)


def register(spark: SparkSession) -> None:
    """Make ``replay_jobs`` known to SQL in this session."""
    spark.udtf.register("replay_jobs", udtf(ReplayJobs))
