"""Compare a registered query with its SQL oracle in DuckDB, as multisets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return plain(list(value.asDict().values()))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows_of(names, found.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def difference(df, sf_dir: str, sql: str) -> str:
    """'' if equal, else what differs first."""
    names, want = oracle_rows(sf_dir, sql)
    have_names, have = spark_rows(df)
    if names != have_names:
        return f"columns {have_names}, oracle {names}"
    if have == want:
        return ""
    return f"{sum(have.values())} rows, oracle {sum(want.values())}; only here {list((have - want).items())[:2]}; only there {list((want - have).items())[:2]}"
