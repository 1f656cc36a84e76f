"""A bit filter before a shuffle: rows that can't find a partner stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MAX_BITS = 1 << 28
PAGE = 15


def likely_members(rows: DataFrame, key: str, keys: DataFrame, count: int) -> DataFrame:
    """Rows whose 64-bit hash ``key`` is likely among ``keys`` (a column of the same name).

    None that is goes missing; about one in 16 of the others stays. The bitmap has 16 bits per key
    and is broadcast up to 32 MB; over that all rows are returned, and the join that follows
    shuffles them. ``count`` is the number of keys.
    """
    bits = max(1 << PAGE, 1 << (max(1, count * BITS_PER_KEY) - 1).bit_length())
    if bits > MAX_BITS:
        return rows
    spot = F.col(key).bitwiseAND(F.lit(bits - 1))
    within = (1 << PAGE) - 1
    pages = (
        keys.select(spot.alias("__spot"))
        .groupBy(F.shiftright("__spot", PAGE).alias("__page"))
        .agg(F.bitmap_construct_agg(F.col("__spot").bitwiseAND(F.lit(within))).alias("__bits"))
    )
    placed = rows.withColumns({"__at": spot.bitwiseAND(F.lit(within)), "__of": F.shiftright(spot, PAGE)})
    met = placed.join(F.broadcast(pages), F.col("__of") == F.col("__page"))
    bit = F.expr("shiftright(cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) & 1")
    return met.where(bit == 1).select(*rows.columns)
