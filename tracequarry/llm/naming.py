"""Column names for inner use that can't clash with those of the tables given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``df`` is called so, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The top-level column of this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
