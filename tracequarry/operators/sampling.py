"""Deterministic sampling of task manifests.

A shuffle is an order by ``sha2(seed:epoch:id)``: the same on any engine and any partitioning. The
contract of each sampler holds (a permutation per epoch, balance, strata); the permutations are not
those of a sequential random generator.

Positions over a whole manifest come from ``positioned``, which ranks within ranges of the lot and
adds the ranges' offsets, so no task sorts the whole table or a whole family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lot(key: Column | str, seed: Column | int, epoch: Column | int = 0) -> Column:
    """Place of a key in the shuffle of an epoch."""
    key = F.col(key) if isinstance(key, str) else key
    as_text = [x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in (seed, epoch)]
    return F.sha2(F.concat_ws(":", *as_text, key.cast("string")), 256)


def positioned(rows: DataFrame, lot_col: str, ties: list[str], out: str = "pos", by: list[str] | None = None) -> DataFrame:
    """Position from 0 in the order of a hexadecimal lot, within ``by`` where given, by two-level ranks.

    Lots are spread evenly, so equal ranges of them hold equal shares; there are as many ranges as
    shuffle partitions, and a group that holds most rows spans all of them.
    """
    by = by or []
    parts = max(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coarse = rows.withColumn("__range", F.floor(F.conv(F.substring(lot_col, 1, 8), 16, 10).cast("double") * (parts / 2**32)).cast("int"))
    order = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        coarse.groupBy(*by, "__range")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__ahead", F.coalesce(F.sum("__n").over(order), F.lit(0)))
        .select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__of"), "__ahead")
    )
    same = F.col("__range") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(lot_col, *ties))
    ranked = coarse.withColumn("__inside", inside)
    return ranked.join(offsets, same).withColumn(out, (F.col("__ahead") + F.col("__inside") - 1).cast("long")).drop("__range", "__ahead", "__of", "__inside", *(f"__{c}" for c in by))


def shuffle_epoch_bundles(manifest: DataFrame, key: str, size: int, seed: int, epoch: int = 1) -> DataFrame:
    """Every task with its position and bundle in one shuffled epoch (epochs count from 1)."""
    dealt = manifest.withColumn("lot", lot(key, seed, epoch))
    return positioned(dealt, "lot", [key]).drop("lot").withColumn("bundle", F.floor(F.col("pos") / size).cast("int"))


def family_epoch_bundles(manifest: DataFrame, key: str, family: str, size: int, seed: int, epoch: int = 0) -> DataFrame:
    """Every task with its place in a family-balanced epoch: families in turn, each shuffled."""
    dealt = manifest.withColumn("lot", lot(key, seed, epoch)).withColumn("turn", lot(F.concat(F.lit("family:"), F.col(family)), seed, epoch))
    ranked = positioned(dealt, "lot", [key], "rn", [family])
    # the families still in turn at a rank are those with more members: positions are prefix sums over ranks
    ranks = ranked.groupBy("rn").agg(F.count(F.lit(1)).alias("width"))
    return (
        _after(ranked, ranks)
        .withColumn("pos", F.col("ahead") + F.col("nth") - 1)
        .drop("lot", "turn", "ahead", "nth", "width")
        .withColumn("bundle", F.floor(F.col("pos") / size).cast("int"))
    )


def _after(ranked: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows with the tasks of lower ranks (``ahead``) and their place by turn within their rank (``nth``)."""
    inside = Window.partitionBy("block").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for 4,096 ranks
    blocked = ranks.withColumn("block", F.floor(F.col("rn") / 4096))
    sums = blocked.groupBy("block").agg(F.sum("width").alias("w")).select(F.col("block").alias("of"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    ahead = blocked.withColumn("inside", F.coalesce(F.sum("width").over(inside), F.lit(0))).join(sums, F.col("block") == F.col("of"))
    ahead = ahead.select(F.col("rn").alias("__rn"), (F.col("base") + F.col("inside")).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("rn").orderBy("turn"))  # at most one task of each family
    return ranked.withColumn("nth", nth).join(ahead, F.col("rn") == F.col("__rn")).drop("__rn")


def bundle_mode(round_index: Column, frequency: int = 2) -> Column:
    """'same_family' in every ``frequency``-th round, else 'diverse'."""
    if frequency <= 0:
        return F.lit("diverse")
    if frequency == 1:
        return F.lit("same_family")
    return F.when((F.greatest(round_index, F.lit(0)) + 1) % frequency == 0, "same_family").otherwise("diverse")


def same_family_bundle(manifest: DataFrame, key: str, family: str, variation: str, size: int, seed: int, round_index: int) -> DataFrame:
    """Tasks of the family whose turn it is: first one of each variation, then others, from a rotating start."""
    names = sorted(r[0] for r in manifest.select(family).where(F.col(family).isNotNull()).distinct().collect())  # families are few
    if not names:
        return manifest.limit(0).withColumn("pos", F.lit(0))
    epoch, turn = divmod(max(0, round_index), len(names))
    import hashlib

    names.sort(key=lambda f: hashlib.sha256(f"{seed}:{epoch}:family:{f}".encode()).hexdigest())
    own = manifest.where(F.col(family) == names[turn]).dropDuplicates([key])
    n = own.count()
    per_epoch = max(1, -(-n // size))
    item_epoch, start = epoch // per_epoch, epoch % per_epoch * size
    placed = positioned(own.withColumn("lot", lot(key, seed, item_epoch)), "lot", [key], "at")
    placed = placed.withColumn("at", F.pmod(F.col("at") - start, F.lit(max(n, 1))))
    again = F.row_number().over(Window.partitionBy(variation).orderBy("at")) > 1
    top = placed.withColumn("again", again).orderBy("again", "at").limit(size)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("again", "at")) - 1).drop("lot", "again", "at")


def mixed_bundle(manifest: DataFrame, key: str, family: str, variation: str, size: int, seed: int, round_index: int, frequency: int = 2) -> DataFrame:
    """A diverse bundle, or in its rounds a same-family one, filled up from the diverse one."""
    per_epoch = max(1, -(-manifest.count() // size))
    epoch, at = divmod(max(0, round_index), per_epoch)
    diverse = family_epoch_bundles(manifest, key, family, size, seed, epoch).where(F.col("bundle") == at).select(*manifest.columns, "pos")
    same_round = frequency == 1 or (frequency > 1 and (max(0, round_index) + 1) % frequency == 0)
    if not same_round:
        return diverse
    turn = round_index if frequency <= 1 else round_index // frequency
    same = same_family_bundle(manifest, key, family, variation, size, seed, turn).select(*manifest.columns, "pos")
    fill = diverse.join(same.select(key), key, "left_anti").withColumn("pos", F.col("pos") + F.lit(1 << 40))
    ranked = same.unionByName(fill.select(*same.columns)).orderBy("pos").limit(size)
    return ranked.withColumn("pos", F.row_number().over(Window.orderBy("pos")) - 1)


def stratified_split(manifest: DataFrame, key: str, stratum: str, scenario: str, per_stratum: int, seed: int, *, strict: bool = True) -> DataFrame:
    """Per stratum ``per_stratum`` scenarios, each by one task.

    A stratum with too few fails the query, or, if not ``strict``, keeps what it has.
    """
    dealt = manifest.withColumn("lot", lot(key, seed))
    one = dealt.groupBy(stratum, scenario).agg(F.min(F.struct("lot", *manifest.columns)).alias("t")).select("t.*", lot(F.col(f"t.{scenario}"), seed).alias("turn"))
    by = Window.partitionBy(stratum)
    rows = one.withColumns({"rn": F.row_number().over(by.orderBy("turn", "lot")), "held": F.count(F.lit(1)).over(by)})
    short = F.concat(F.lit("too few scenarios in "), F.coalesce(F.col(stratum).cast("string"), F.lit("null")))
    checked = F.when((F.col("held") < per_stratum) & F.lit(strict), F.raise_error(short).cast(dict(manifest.dtypes)[key])).otherwise(F.col(key))
    return rows.where(F.col("rn") <= per_stratum).withColumn(key, checked).drop("lot", "turn", "rn", "held")


def looked_up(ids: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The whole item of each id; an id without one keeps its key alone."""
    return ids.join(items, key, "left")


def bundle_counts(tasks: int, size: int, epochs: int) -> tuple[int, int]:
    """(bundles of an epoch, bundles of all epochs)."""
    each = -(-tasks // max(1, size))
    return each, each * epochs


def balanced_by_count(manifest: DataFrame, key: str, family: str, counts: DataFrame, count: str, size: int, seed: int) -> DataFrame:
    """Tasks of the least served families first, those at one level in turn.

    ``counts`` has family and count; a family it lacks counts 0. Equal counts make it a plain sample.
    """
    known = counts.select(F.col(family), F.col(count).alias("served"))
    dealt = manifest.join(known, family, "left").withColumn("served", F.coalesce("served", F.lit(0))).withColumn("lot", lot(key, seed))
    spread = dealt.agg((F.min("served") == F.max("served")).alias("even")).first()["even"]
    if spread is None or spread:
        return dealt.orderBy("lot", key).limit(size).drop("lot", "served")
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy(family).orderBy("lot", key)))
    turn = lot(F.concat_ws("/", F.col("rn").cast("string"), F.col(family)), seed)
    return ranked.withColumn("turn", turn).orderBy("served", "rn", "turn", key).limit(size).drop("lot", "served", "rn", "turn")


def half_low_sample(manifest: DataFrame, key: str, low: DataFrame, low_key: str, size: int, seed: int) -> DataFrame:
    """Up to half from the low-reward tasks, the rest from the others, topped up from any."""
    ids = low.select(F.col(low_key).alias(key)).distinct()
    dealt = manifest.withColumn("lot", lot(key, seed))
    first = dealt.join(ids, key, "left_semi").orderBy("lot", key).limit(size // 2)
    others = dealt.join(ids, key, "left_anti").withColumn("tier", F.lit(1))
    rest = dealt.join(ids, key, "left_semi").join(first.select(key), key, "left_anti").withColumn("tier", F.lit(2))
    taken = first.count()
    more = others.unionByName(rest.select(*others.columns)).orderBy("tier", "lot", key).limit(size - taken)
    return first.drop("lot").unionByName(more.drop("lot", "tier"))


def worker_of(position: Column, workers: int) -> Column:
    """Static round robin."""
    return F.pmod(position, F.lit(workers)).cast("int")


def limited(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """First rows in order; no limit or one of 0 or less keeps all."""
    return rows if limit is None or limit <= 0 else rows.orderBy(*order).limit(limit)
