"""Window functions over keys of any size: scans within ranges, joined by what each range passes on.

Rows are dealt into ranges of (key, order), so a key that holds most rows lies in many ranges, and each
range is scanned by itself. What a range passes on for a key is small: how many rows it has, or its last
values. Prefixes of these over the ranges, one row for each key and range, are joined back.

Tables in which no key has more than ``most`` rows need none of this, and plain windows are used. Rows of
a key with equal order columns are as good as interchangeable and lie in one range. A null key is a key of
its own; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.session import staged

#: Rows of one key that a task may sort.
MOST = 1_000_000
PART, OF, PASSED = "__part", "__of", "__passed"


def large(rows: DataFrame, key: str, most: int = MOST) -> bool:
    """Whether some key has more rows than a task may sort."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (sizes.agg(F.max("n")).head()[0] or 0) > most


def ranges(rows: DataFrame, key: str, order: list[str], most: int = MOST) -> DataFrame:
    """Rows with the number of their range of (key, order); ranges rise with it."""
    by = [key, *order]
    parts = max(1, -(-rows.count() // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return staged(rows.repartitionByRange(parts, *by).withColumn(PART, F.spark_partition_id()), "ranges")


def passed_on(dealt: DataFrame, key: str, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Rows with the columns of ``carry``, which are window expressions over the summaries of a key's ranges."""
    each = dealt.groupBy(PART, key).agg(*(c.alias(n) for n, c in summary.items()))
    found = each.select(F.col(PART).alias(OF), F.col(key).alias(PASSED), *(c.alias(n) for n, c in carry.items()))
    return dealt.join(found, (F.col(PART) == F.col(OF)) & F.col(key).eqNullSafe(F.col(PASSED))).drop(OF, PASSED)


def inside(key: str, order: list[str]) -> Window:
    return Window.partitionBy(PART, key).orderBy(*order)


def before(key: str, size: int | None = None) -> Window:
    """The ranges of a key before this one, all or the last ``size``."""
    return Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding if size is None else -size, -1)


def ranked(rows: DataFrame, key: str, order: list[str], most: int = MOST) -> DataFrame:
    """Rows with their place from the start (``rn``), from the end (``rev``), both from 1, of their key's rows."""
    if not large(rows, key, most):
        w = Window.partitionBy(key)
        forward = F.row_number().over(w.orderBy(*order)).cast("long")
        return rows.withColumn("rn", forward).withColumn("rev", F.row_number().over(w.orderBy(*(F.desc(c) for c in order))).cast("long"))
    dealt = ranges(rows, key, order, most)
    carry = {"__ahead": F.coalesce(F.sum("__n").over(before(key)), F.lit(0)), "__all": F.sum("__n").over(Window.partitionBy(key))}
    met = passed_on(dealt, key, {"__n": F.count(F.lit(1))}, carry)
    met = met.withColumn("rn", F.row_number().over(inside(key, order)) + F.col("__ahead"))
    return met.withColumn("rev", F.col("__all") - F.col("rn") + 1).drop(PART, "__ahead", "__all")


def lagged(rows: DataFrame, key: str, order: list[str], value: Column, out: str, most: int = MOST) -> DataFrame:
    """Rows with the value of the row before them in ``out``; null for the first."""
    if not large(rows, key, most):
        return rows.withColumn(out, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    dealt = ranges(rows.withColumn("__value", F.struct(value.alias("v"))), key, order, most)
    last = {"__last": F.max_by("__value", F.struct(*order))}
    met = passed_on(dealt, key, last, {"__carry": F.lag("__last").over(Window.partitionBy(key).orderBy(PART))})
    own = F.coalesce(F.lag("__value").over(inside(key, order)), F.col("__carry"))
    return met.withColumn(out, own["v"]).drop(PART, "__value", "__carry")


def history(rows: DataFrame, key: str, order: list[str], value: Column, size: int, out: str = "history", most: int = MOST) -> DataFrame:
    """Rows with the values of the ``size`` rows before them, oldest first; nulls are left out, but count as rows."""
    if not large(rows, key, most):
        return rows.withColumn(out, F.collect_list(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-size, -1)))
    dealt = ranges(rows.withColumn("__value", F.struct(value.alias("v"))), key, order, most)
    at = Window.partitionBy(PART, key).orderBy(*(F.desc(c) for c in order))
    tails = dealt.withColumn("__rev", F.row_number().over(at)).where(F.col("__rev") <= size)
    tail = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__rev")).alias("i"), F.col("__value").alias("s")))), lambda x: x["s"])
    each = tails.groupBy(PART, key).agg(tail.alias("__tail"))
    # every range has a row of the key, so the last ``size`` ranges have all that is asked for
    carry = F.flatten(F.collect_list("__tail").over(before(key, size)))
    found = each.select(F.col(PART).alias(OF), F.col(key).alias(PASSED), carry.alias("__carry"))
    met = dealt.join(found, (F.col(PART) == F.col(OF)) & F.col(key).eqNullSafe(F.col(PASSED))).drop(OF, PASSED)
    met = met.withColumn("__own", F.collect_list("__value").over(inside(key, order).rowsBetween(-size, -1)))
    missing = F.least(F.size("__carry"), F.lit(size) - F.size("__own"))
    both = F.concat(F.slice("__carry", F.size("__carry") - missing + 1, missing), F.col("__own"))
    return met.withColumn(out, F.transform(F.filter(both, lambda s: s["v"].isNotNull()), lambda s: s["v"])).drop(PART, "__value", "__carry", "__own")


def runs(rows: DataFrame, key: str, order: list[str], value: Column, most: int = MOST) -> DataFrame:
    """(key, run, value, n): runs of equal neighbours of each key in order, numbered from 1, nulls equal to each other.

    A run that spans ranges is one run: a row begins one if it differs from the row before it, wherever
    that lies, and the numbers of runs are prefix sums of such rows.
    """
    kept = rows.select(key, *order, value.alias("value"))
    first = ranked(lagged(kept, key, order, F.struct(F.col("value").alias("v")), "__before", most), key, order, most)
    fresh = F.col("__before").isNull() | ~F.col("__before")["v"].eqNullSafe(F.col("value"))
    flagged = first.withColumn("__new", fresh.cast("long"))
    if not large(rows, key, most):
        number = F.sum("__new").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        numbered = flagged.withColumn("run", number)
    else:
        dealt = ranges(flagged, key, order, most)
        met = passed_on(dealt, key, {"__n": F.sum("__new")}, {"__ahead": F.coalesce(F.sum("__n").over(before(key)), F.lit(0))})
        numbered = met.withColumn("run", F.sum("__new").over(inside(key, order).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__ahead"))
    return numbered.groupBy(key, "run").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n")).select(key, "run", "value", "n")
