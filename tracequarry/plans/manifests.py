"""Audit and sampling queries. Parts and customers stand for task manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import audit, sampling
from tracequarry.plans.base import Plans, table

P = Plans()


@P.query("""
WITH h AS (SELECT DISTINCT o_custkey, o_orderpriority AS s FROM orders)
SELECT a.o_custkey, a.s AS split_a, b.s AS split_b FROM h a JOIN h b ON a.o_custkey = b.o_custkey AND a.s < b.s""")
def split_overlap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlaps(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")


@P.query("""
WITH h AS (SELECT DISTINCT c_nationkey, c_mktsegment AS s FROM customer)
SELECT a.c_nationkey, a.s AS split_a, b.s AS split_b FROM h a JOIN h b ON a.c_nationkey = b.c_nationkey AND a.s < b.s""")
def split_overlap_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlaps(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@P.query("""
SELECT p_type, count(*) AS n, sha256(string_agg(p_partkey || chr(9) || p_name, chr(10) ORDER BY p_partkey)) AS fingerprint FROM part GROUP BY 1""")
def manifest_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("p_partkey").cast("string"), F.lit("\t"), F.col("p_name"))
    return audit.fingerprint(table(spark, sf_dir, "part"), line, ["p_partkey"], ["p_type"])


@P.query("""
WITH a AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier),
b AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier WHERE s_suppkey % 7 <> 0),
m AS (SELECT coalesce(a.s_nationkey, b.s_nationkey) AS s_nationkey, coalesce(a.pos, b.pos) AS pos, a.s_suppkey AS f, b.s_suppkey AS e
  FROM a FULL JOIN b ON a.s_nationkey = b.s_nationkey AND a.pos = b.pos WHERE a.s_suppkey IS DISTINCT FROM b.s_suppkey)
SELECT s_nationkey, min(pos) AS pos, coalesce(CAST(arg_min(f, pos) AS VARCHAR), '<missing>') AS found,
  CASE WHEN count(e) FILTER (pos = (SELECT min(pos) FROM m n WHERE n.s_nationkey = m.s_nationkey)) = 0 THEN '<extra>' ELSE CAST(arg_min(e, pos) AS VARCHAR) END AS expected
FROM m GROUP BY 1""")
def order_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("id", F.col("s_suppkey").cast("string"))
    have = audit.positions(rows, "id", ["s_suppkey"], "s_nationkey")
    want = audit.positions(rows.where("s_suppkey % 7 <> 0"), "id", ["s_acctbal", "s_suppkey"], "s_nationkey")
    return audit.order_mismatch(have, want, "s_nationkey").withColumn("pos", F.col("pos").cast("long"))


@P.query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@P.query("""
SELECT p_type, p_brand, string_agg(v, ',' ORDER BY v) AS variants FROM (SELECT DISTINCT p_type, p_brand, CAST(p_size % 7 + 1 AS VARCHAR) AS v FROM part)
GROUP BY 1, 2 HAVING string_agg(v, ',' ORDER BY v) <> '1,2,3,4,5,6,7'""")
def variant_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("v", F.col("p_size") % 7 + 1)
    found = audit.incomplete_variants(rows, ["p_type", "p_brand"], "v", list(range(1, 8)))
    return found.withColumn("variants", F.array_join(F.col("variants").cast("array<string>"), ","))


@P.query("SELECT p_partkey, p_name, i AS ord FROM (VALUES (17, 0), (3, 1), (99, 2), (42, 3)) v(k, i) JOIN part ON p_partkey = k")
def select_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    indices = spark.createDataFrame([(17, 0), (3, 1), (99, 2), (42, 3)], "k long, i int")
    return audit.select_by_index(table(spark, sf_dir, "part"), "p_partkey", indices, "k", "i").select("p_partkey", "p_name", "ord")


@P.query(" UNION ALL ".join(
    f"SELECT '{part}' AS part, i AS ord, k AS p_partkey, p_name FROM (SELECT unnest({list(keys)}) AS k, unnest(range({len(keys)})) AS i) JOIN part ON p_partkey = k" for part, keys in audit.COHORT.items()
))
def fixed_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the index lists of the fixed cohort, as far as the table has them."""
    return audit.fixed_cohort(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("p_partkey"), "p_name"), "p_partkey").withColumn("ord", F.col("ord").cast("long")).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@P.query("""SELECT count(*) AS strata, min(n) AS least, max(n) AS most, count(*) = 6 AND min(n) = 16 AND max(n) = 16 AS holds FROM (SELECT count(*) AS n FROM part GROUP BY p_type)""")
def stratum_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stratum_invariant(table(spark, sf_dir, "part"), "p_type", 6, 16)


@P.query("SELECT p_type AS key, count(*) AS n FROM part GROUP BY 1")
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@P.query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def split_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of any customer and any supplier."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"))
    return a.intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@P.query("SELECT p_partkey, row_number() OVER (ORDER BY sha256('42:1:' || p_partkey), p_partkey) - 1 AS pos, CAST((row_number() OVER (ORDER BY sha256('42:1:' || p_partkey), p_partkey) - 1) // 4 AS INTEGER) AS bundle FROM part")
def shuffle_epoch_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffle_epoch_bundles(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 4, 42)


@P.query("""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:0:' || c_custkey), c_custkey) - 1 AS rn FROM customer),
o AS (SELECT *, row_number() OVER (ORDER BY rn, sha256('42:0:family:' || c_mktsegment)) - 1 AS pos FROM r)
SELECT c_custkey, c_mktsegment, rn, pos, CAST(pos // 4 AS INTEGER) AS bundle FROM o""")
def family_epoch_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sampling.family_epoch_bundles(rows, "c_custkey", "c_mktsegment", 4, 42)


@P.query("""
WITH f AS (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY sha256('42:0:family:' || c_mktsegment) LIMIT 1 OFFSET 2),
p AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY sha256('42:0:' || c_custkey), c_custkey) - 1 AS spot FROM customer WHERE c_mktsegment = (SELECT c_mktsegment FROM f)),
v AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spot) > 1 AS again FROM p)
SELECT c_custkey, CAST(row_number() OVER (ORDER BY again, spot) - 1 AS INTEGER) AS pos FROM v ORDER BY again, spot LIMIT 30""")
def same_family_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return sampling.same_family_bundle(rows, "c_custkey", "c_mktsegment", "c_nationkey", 30, 42, 2).select("c_custkey", "pos")


@P.query("""
WITH one AS (SELECT p_type, p_brand, arg_min(p_partkey, sha256('42:0:' || p_partkey)) AS p_partkey FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY sha256('42:0:' || p_brand)) AS rn FROM one)
SELECT p_partkey, p_type, p_brand FROM r WHERE rn <= 16""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return sampling.stratified_split(rows, "p_partkey", "p_type", "p_brand", 16, 42, strict=False)


@P.query("""
WITH n AS (SELECT s_nationkey AS k, count(*) AS served FROM supplier GROUP BY 1),
d AS (SELECT c_custkey, c_nationkey, coalesce(served, 0) AS served, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('42:0:' || c_custkey), c_custkey) AS rn
  FROM customer LEFT JOIN n ON k = c_nationkey)
SELECT c_custkey, c_nationkey FROM d ORDER BY served, rn, sha256('42:0:' || rn || '/' || c_nationkey), c_custkey LIMIT 50""")
def balanced_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("served_count"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return sampling.balanced_by_count(rows, "c_custkey", "c_nationkey", served, "served_count", 50, 42).select("c_custkey", "c_nationkey")


@P.query("""
WITH low AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice < 2000),
d AS (SELECT c_custkey, sha256('42:0:' || c_custkey) AS h, c_custkey IN (SELECT o_custkey FROM low) AS is_low FROM customer),
f AS (SELECT c_custkey FROM d WHERE is_low ORDER BY h, c_custkey LIMIT 20),
m AS (SELECT c_custkey FROM d WHERE c_custkey NOT IN (SELECT c_custkey FROM f) ORDER BY is_low, h, c_custkey LIMIT 40 - (SELECT count(*) FROM f))
SELECT * FROM f UNION ALL SELECT * FROM m""")
def half_low_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "orders").where("o_totalprice < 2000").select("o_custkey")
    return sampling.half_low_sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", low, "o_custkey", 40, 42)


@P.query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY sha256('42:1:' || p_partkey)) - 1) % 4 AS INTEGER) AS worker FROM part")
def worker_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sampling.shuffle_epoch_bundles(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 4, 42)
    return dealt.select("p_partkey", sampling.worker_of(F.col("pos"), 4).alias("worker"))


@P.query("SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN (event_id + 1) % 3 = 0 THEN 'same_family' ELSE 'diverse' END AS mode FROM events")
def bundle_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sampling.bundle_mode(F.col("event_id"), 3).alias("mode"))


@P.query("""
WITH f AS (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY sha256('42:0:family:' || c_mktsegment) LIMIT 1 OFFSET 1),
p AS (SELECT *, row_number() OVER (ORDER BY sha256('42:0:' || c_custkey), c_custkey) - 1 AS spot FROM customer WHERE c_mktsegment = (SELECT c_mktsegment FROM f)),
v AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spot) > 1 AS again FROM p),
same AS (SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (ORDER BY again, spot) AS pos FROM v ORDER BY again, spot LIMIT 40),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:0:' || c_custkey), c_custkey) AS rn FROM customer),
o AS (SELECT *, row_number() OVER (ORDER BY rn, sha256('42:0:family:' || c_mktsegment)) - 1 AS pos FROM r),
fill AS (SELECT c_custkey, c_mktsegment, c_nationkey, pos + 1000000000 AS pos FROM o WHERE pos // 40 = 3 AND c_custkey NOT IN (SELECT c_custkey FROM same))
SELECT c_custkey, c_mktsegment, c_nationkey, CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS pos FROM (SELECT * FROM same UNION ALL SELECT * FROM fill ORDER BY pos LIMIT 40)""")
def mixed_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return sampling.mixed_bundle(rows, "c_custkey", "c_mktsegment", "c_nationkey", 40, 42, 3)
