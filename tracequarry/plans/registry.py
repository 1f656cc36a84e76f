"""All queries of the engine with their SQL oracles, collected from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracequarry.plans import ledgers, lifecycle, manifests, records, runs, scans, steps, streams, texts, vectors

FLAGSHIP = "longitudinal_pairs"
Query = Callable[[SparkSession, str], DataFrame]


MODULES = (runs, steps, manifests, ledgers, lifecycle, vectors, texts, records, scans, streams)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.P.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.P.sql.items()}
