"""Audits of task manifests: overlaps, duplicates, order, completeness, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.operators import fold, scan
from tracequarry.session import staged


def overlaps(rows: DataFrame, split: str, key: str) -> DataFrame:
    """(key, split_a, split_b) for keys that two splits share; splits per key are few, so no self-join."""
    held = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
    pairs = F.flatten(
        F.transform(
            "splits", lambda a, i: F.transform(F.slice("splits", i + 2, F.size("splits")), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))
        )
    )
    return held.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fingerprint(rows: DataFrame, line: Column, order: list[str], by: list[str] | None = None, most: int = scan.MOST) -> DataFrame:
    """SHA-256 of the lines joined by newlines in order; null lines are left out, but count.

    Where a group has more than ``most`` rows, its lines stream through a fold instead of one value.
    """
    by = by or []
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).head()[0] or 0) > most:
        return fold.fingerprint(rows, line, order, by)
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["__line"]), "\n")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sha2(joined, 256).alias("fingerprint"))


def positions(rows: DataFrame, key: str, order: list[str], by: str | None = None) -> DataFrame:
    """(value, pos) with the position of each row from 0, in order, within ``by`` where given.

    Over a whole table rows are dealt into ranges of the order, ranked there, and moved up by what
    the ranges before hold, so no task sorts the table.
    """
    if by:
        w = Window.partitionBy(by).orderBy(*order)
        return rows.select(by, F.col(key).alias("value"), (F.row_number().over(w) - 1).alias("pos"))
    dealt = staged(
        rows.select(F.col(key).alias("value"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)))
        .repartitionByRange(*(f"__o{i}" for i in range(len(order))))
        .withColumn("__part", F.spark_partition_id()),
        "positions",
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*(f"__o{i}" for i in range(len(order)))))
    return dealt.join(offsets, "__part").select("value", (F.col("__ahead") + inside - 1).alias("pos"))


# fixed values: the indices of the tasks of the fixed cohort, in their order
COHORT = {
    "train": (
        1386, 1271, 1400, 105, 334, 1408, 368, 1422, 897, 1286, 1188, 621, 25, 1035, 142, 1343,
        792, 1109, 1283, 1468, 1111, 180, 889, 361, 1124, 224, 914, 226, 640, 1282, 747, 1099,
        729, 1122, 619, 1209, 276, 450, 328, 292, 110, 1148, 196, 493, 514, 1341, 766, 238,
        1030, 1203, 574, 645, 618, 1351, 1472, 1313, 1365, 326, 331, 899, 1186, 147, 1375, 1327,
        1340, 1121, 79, 847, 958, 1092, 1239, 904, 1170, 471, 1242, 174, 392, 1290, 760, 1369,
        202, 320, 699, 171, 81, 1345, 923, 1211, 1221, 956, 1015, 436, 353, 622, 1219, 953,
    ),
    "val": (
        154, 78, 82, 54, 65, 185, 137, 89, 100, 62, 136, 109, 86, 46, 49, 193,
        150, 119, 13, 67, 157, 190, 171, 91, 64, 47, 156, 167, 51, 33, 36, 143,
        177, 126, 165, 73, 61, 176, 116, 153, 149, 188, 160, 41, 20, 68, 123, 135,
    ),
}


def fixed_cohort(rows: DataFrame, key: str) -> DataFrame:
    """(part, ord, columns of rows): the rows whose key is an index of the cohort, in its order; those missing are left out."""
    wanted = [(part, i, k) for part, keys in COHORT.items() for i, k in enumerate(keys)]
    listed = rows.sparkSession.createDataFrame(wanted, "part string, ord int, __index long")
    return F.broadcast(listed).join(rows, F.col("__index") == F.col(key)).drop("__index")


def order_mismatch(have: DataFrame, want: DataFrame, by: str | None = None) -> DataFrame:
    """First position at which two position tables differ, with both values there."""
    on = ["pos", *([by] if by else [])]
    met = have.withColumnRenamed("value", "found").join(want.withColumnRenamed("value", "expected"), on, "full_outer")
    off = met.where(~F.col("found").eqNullSafe(F.col("expected")))
    first = F.min(F.struct("pos", F.coalesce("found", F.lit("<missing>")).alias("found"), F.coalesce("expected", F.lit("<extra>")).alias("expected")))
    return off.groupBy(*([by] if by else [])).agg(first.alias("f")).select(*([by] if by else []), "f.*").where(F.col("pos").isNotNull())


def incomplete_variants(rows: DataFrame, family: list[str], variant: str, wanted: list) -> DataFrame:
    """Families whose set of variants isn't the wanted one."""
    found = rows.groupBy(*family).agg(F.array_sort(F.collect_set(variant)).alias("variants"))
    return found.where(F.col("variants") != F.array(*(F.lit(v) for v in sorted(wanted))))


def select_by_index(rows: DataFrame, key: str, indices: DataFrame, index: str, order: str) -> DataFrame:
    """Rows named by an index list, in its order; a name that no row has fails the query."""
    met = indices.select(F.col(index).alias("__index"), F.col(order).alias("ord")).join(rows, F.col("__index") == F.col(key), "left")
    checked = F.when(F.col(key).isNull(), F.raise_error(F.concat(F.lit("no row for index "), F.col("__index").cast("string")))).otherwise(F.col(key))
    return met.withColumn(key, checked).drop("__index")


def stratum_invariant(rows: DataFrame, stratum: str, strata: int, cap: int) -> DataFrame:
    """One row: the number of strata, least and most per stratum, and whether all is as wanted."""
    per = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("strata"), F.min("n").alias("least"), F.max("n").alias("most")).withColumn(
        "holds", (F.col("strata") == strata) & F.coalesce((F.col("least") == cap) & (F.col("most") == cap), F.lit(False))
    )


def single_value(rows: DataFrame, column: str) -> DataFrame:
    """The only value of a column, or null where it has none or several."""
    return rows.agg(F.when(F.count_distinct(column) == 1, F.max(column)).alias("value"))
