"""Embedding queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import density, embed
from tracequarry.plans.base import Plans, table
from tracequarry.plans.scans import place
from tracequarry.sources import cache

P = Plans()
K, THRESHOLD = 8, 0.35
KNN_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.e, b.e), 6) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour) AS rn FROM s QUALIFY rn <= 8),
m AS (SELECT a.vec_id AS a, a.neighbour AS b, a.cosine FROM k a JOIN k b ON a.vec_id = b.neighbour AND a.neighbour = b.vec_id WHERE a.vec_id < a.neighbour AND a.cosine >= 0.35)
"""


@P.query(KNN_SQL + "SELECT vec_id, neighbour, cosine, rn FROM k")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.top_neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", K)


@P.query(KNN_SQL + "SELECT a, b, cosine FROM m")
def mutual_knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = embed.top_neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", K)
    return embed.mutual_edges(near, "vec_id", THRESHOLD)


COMPONENTS_SQL = KNN_SQL + """, w AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT w.b, reach.root FROM reach JOIN w ON w.a = reach.node),
g AS (SELECT node AS vec_id, min(root) AS grp FROM reach GROUP BY 1)
"""


@P.query(COMPONENTS_SQL + "SELECT vec_id, grp FROM g")
def semantic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.semantic_groups(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", K, THRESHOLD)


@P.query("""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, CAST(round(round(list_dot_product(a.e, b.e), 6) * 1000000) AS BIGINT) AS likeness FROM u a JOIN u b ON a.vec_id <> b.vec_id),
c AS (SELECT a, likeness AS core FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY likeness DESC) = 5),
r AS MATERIALIZED (SELECT s.a, s.b, least(likeness, x.core, y.core) AS reach FROM s JOIN c x ON x.a = s.a JOIN c y ON y.a = s.b),
prim(step, node, done, best) AS (
  SELECT 0, vec_id, vec_id = (SELECT min(vec_id) FROM embeddings), coalesce(r.reach, 0) FROM embeddings LEFT JOIN r ON r.a = (SELECT min(vec_id) FROM embeddings) AND r.b = vec_id
  UNION ALL
  SELECT step + 1, p.node, done OR p.node = pick, CASE WHEN done OR p.node = pick THEN best ELSE greatest(best, r.reach) END
  FROM (SELECT *, arg_max(node, best) FILTER (NOT done) OVER () AS pick FROM prim) p LEFT JOIN r ON r.a = pick AND r.b = p.node WHERE pick IS NOT NULL
)
SELECT best AS reach, count(*) AS n_edges FROM prim WHERE step = (SELECT count(*) - 1 FROM embeddings) AND node <> (SELECT min(vec_id) FROM embeddings) GROUP BY 1""")
def density_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges of the tree of mutual reach lie at each level, which is the same for every such tree."""
    tree, _ = density.reach_tree(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)
    return tree.groupBy("reach").agg(F.count(F.lit(1)).alias("n_edges"))


@P.query()
def density_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_groups(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5, 5)


@P.query("""
WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 64)) AS dim FROM embeddings), c AS (SELECT label, dim, avg(x) AS x, count(*) AS n FROM e GROUP BY 1, 2)
SELECT label, n, CAST(dim AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM c""")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each label and dimension."""
    made = embed.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return made.select("label", "n", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 5))


@P.query("SELECT doc_id, 'm:' || sha256(text) AS cache_key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 3 = 0").select(embed.cache_key(F.lit("m"), F.col("text")).alias("cache_key"), F.array(F.lit(1.0)).alias("embedding"), "doc_id")
    return embed.cache_split(docs, F.col("text"), "m", embed.latest_cache(old, "doc_id"))[1].select("doc_id", "cache_key")


ENCODED_SQL = """
WITH old AS (SELECT text, CAST(arg_max(n_chars, doc_id) AS DOUBLE) AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
e AS (SELECT d.doc_id, o.text IS NOT NULL AS cached, CASE WHEN o.text IS NOT NULL THEN [3 * o.v, 4 * o.v] ELSE [CAST(length(d.text) AS DOUBLE), CAST(len(string_split(d.text, ' ')) AS DOUBLE)] END AS v
  FROM documents d LEFT JOIN old o ON o.text = d.text)
"""


def counts(texts: list[str]) -> list[list[float]]:
    """An encoder of two counts: characters and words."""
    return [[float(len(t)), float(len(t.split(" ")))] for t in texts]


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vectors from a cache that has every third, else from the encoder of counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    n = F.col("n_chars").cast("double")
    old = docs.where("doc_id % 3 = 0").select(embed.cache_key(F.lit("m"), F.col("text")).alias("cache_key"), F.array(3 * n, 4 * n).alias("embedding"), "doc_id")
    return embed.encode_cached(docs.select("doc_id", "text"), "text", "m", embed.latest_cache(old, "doc_id"), counts)


@P.query(ENCODED_SQL + "SELECT doc_id, cached, round(v[1] / sqrt(v[1] * v[1] + v[2] * v[2]), 6) AS x, round(v[2] / sqrt(v[1] * v[1] + v[2] * v[2]), 6) AS y FROM e")
def encode_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return encoded(spark, sf_dir).select("doc_id", "cached", F.round(e[0], 6).alias("x"), F.round(e[1], 6).alias("y"))


@P.query(ENCODED_SQL + "SELECT 'm' AS model, CAST(sum(CAST(cached AS INTEGER)) AS BIGINT) AS hits, CAST(sum(1 - CAST(cached AS INTEGER)) AS BIGINT) AS misses, count(*) AS count FROM e")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.cache_stats(encoded(spark, sf_dir), "m")


@P.query("""
WITH s AS (SELECT c_custkey, c_nationkey AS g, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
h AS (SELECT *, CASE WHEN n < 4 THEN 'small' ELSE 'g' || g END AS home FROM s),
p AS (SELECT *, count(*) OVER (PARTITION BY home) AS size, row_number() OVER (PARTITION BY home ORDER BY g, c_custkey) - 1 AS spot FROM h)
SELECT c_custkey, home || ':' || CAST(floor(spot * ceil(size / 20) / size) AS BIGINT) AS "window" FROM p""")
def pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over all customers."""
    return embed.pack_windows(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey")


MERGED_SQL = COMPONENTS_SQL + """, x AS (SELECT grp, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 64)) AS dim FROM g JOIN embeddings USING (vec_id)),
d AS (SELECT grp, dim, avg(x) AS x, count(*) AS n FROM x GROUP BY 1, 2),
m2 AS (SELECT grp, max(n) AS n, list(x ORDER BY dim) AS c FROM d GROUP BY 1),
c AS (SELECT grp, n, list_transform(c, lambda y: y / sqrt(list_dot_product(c, c))) AS c FROM m2),
near AS (SELECT a.grp, b.grp AS home, round(list_dot_product(a.c, b.c), 6) AS cosine FROM c a JOIN c b ON a.n < 4 AND b.n >= 4),
best AS (SELECT grp, home FROM near WHERE cosine >= 0.4 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY cosine DESC, home) = 1),
w2 AS (SELECT vec_id, coalesce(home, grp) AS grp FROM g LEFT JOIN best USING (grp))
"""


@P.query(MERGED_SQL + "SELECT vec_id, grp FROM w2")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic groups of which the small ones have joined the large one with the most alike centroid."""
    rows = table(spark, sf_dir, "embeddings")
    found = embed.semantic_groups(rows, "vec_id", "embedding", K, THRESHOLD)
    return embed.merged_by_centroid(rows.select("vec_id", "embedding").join(found, "vec_id"), "vec_id", "grp", "embedding", 4, 0.4)


@P.query(MERGED_SQL + """, s3 AS (SELECT vec_id, grp, count(*) OVER (PARTITION BY grp) AS n FROM w2),
h AS (SELECT *, CASE WHEN n < 4 THEN 'small' ELSE 'g' || grp END AS home FROM s3),
p AS (SELECT *, count(*) OVER (PARTITION BY home) AS size, row_number() OVER (PARTITION BY home ORDER BY grp, vec_id) - 1 AS spot FROM h)
SELECT vec_id, home || ':' || CAST(floor(spot * ceil(size / 20) / size) AS BIGINT) AS "window" FROM p""")
def semantic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.evidence_windows(table(spark, sf_dir, "embeddings"), "vec_id", "vec_id", "semantic", clustering="graph", threshold=THRESHOLD, merge=0.4, k=K)


@P.query("""
WITH p AS (SELECT vec_id, count(*) OVER () AS size, row_number() OVER (ORDER BY label, vec_id) - 1 AS spot FROM embeddings)
SELECT vec_id, 'card:' || CAST(floor(spot * ceil(size / 20) / size) AS BIGINT) AS "window" FROM p""")
def card_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.evidence_windows(table(spark, sf_dir, "embeddings"), "vec_id", "label", "auto", dataset="alfworld")


@P.query("""
WITH p AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS size, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS spot FROM embeddings)
SELECT vec_id, 'r' || label || ':' || CAST(floor(spot * ceil(size / 15) / size) AS BIGINT) AS "window" FROM p""")
def round_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for rounds."""
    return embed.evidence_windows(table(spark, sf_dir, "embeddings"), "vec_id", "vec_id", "auto", dataset="ScienceWorld", rounds="label", least=8, most=15)


@P.query()
def density_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mode of semantic grouping: windows of density clusters."""
    return embed.evidence_windows(table(spark, sf_dir, "embeddings"), "vec_id", "vec_id", "semantic")


def bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Documents with their keys, and a cache to which every third was added, then every ninth again with another vector."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select("doc_id", embed.cache_key(F.lit("m"), F.col("text")).alias("cache_key"))
    name, path = f"cache_{uuid.uuid4().hex}", place(spark, "bucketed")
    for step, generation in ((3, 1), (9, 2)):
        rows = keyed.where(F.col("doc_id") % step == 0).select("cache_key", F.array(F.col("doc_id").cast("double"), F.lit(float(generation))).alias("embedding"))
        cache.appended(rows, name, path, 16, generation)
    return keyed, name


@P.query("SELECT doc_id, 'm:' || sha256(text) AS cache_key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def bucketed_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.misses(*bucketed(spark, sf_dir)).select("doc_id", "cache_key")


@P.query("""
WITH g AS (SELECT text, max(doc_id) AS x, 1 AS gen FROM documents WHERE doc_id % 3 = 0 GROUP BY 1 UNION ALL SELECT text, max(doc_id), 2 FROM documents WHERE doc_id % 9 = 0 GROUP BY 1),
l AS (SELECT text, arg_max(x, gen) AS x, max(gen) AS gen FROM g GROUP BY 1)
SELECT doc_id, CAST(x AS DOUBLE) AS x, CAST(gen AS DOUBLE) AS generation FROM documents JOIN l USING (text)""")
def bucketed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cache.hits(*bucketed(spark, sf_dir))
    return found.select("doc_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("generation"))
