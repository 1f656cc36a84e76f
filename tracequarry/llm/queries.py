"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import (
    centroid_clusters,
    decontam,
    html_text,
    line_dedup,
    media_avi,
    near_dups,
    packing,
    pii,
    ranked_search,
    source_mix,
    token_counts,
    toxicity,
    url_lists,
)
from tracequarry.session import staged

#: Dated list entries of the production URL query: (key, since, action).
URL_LIST = [
    ("spam-farm.example.org", "2024-01-20 00:00:00", "block"),
    ("spam-farm.example.org", "2024-06-01 00:00:00", "withdraw"),
    ("spam-farm.example.org", "2024-09-01 00:00:00", "block"),
    ("cheap-pills.example.com", "2024-03-01 12:00:00", "block"),
    ("cheap-pills.example.com/en", "2024-07-01 00:00:00", "allow"),
    ("www.cheap-pills.example.com", "2024-05-01 00:00:00", "review"),
    ("example.net", "2024-04-01 00:00:00", "review"),
    ("example.net", "2024-04-15 00:00:00", "withdraw"),
    ("blog.ththan.example.net", "2024-02-01 00:00:00", "allow"),
    ("ththed.example.org", "2024-08-01 00:00:00", "block"),
    ("ththed.example.org/de/252", "2024-01-01 00:00:00", "allow"),
    ("org", "2024-11-01 00:00:00", "review"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # staged: the sums read it twice, and texts are to be encoded once
    histogram = staged(token_counts.length_histogram(table(spark, sf_dir, "documents")), "token-histogram")
    return token_counts.suffix_sums(histogram)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("version")


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).drop("version")


#: Key of the production query; give your own where pseudonyms must not be recomputed by others.
PII_KEY = b"tracequarry production query"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(table(spark, sf_dir, "documents"), PII_KEY)


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    """What the labels tell apart: toxic text of low quality, toxic text of good quality, then any toxic text, which decides.

    The last model reads the probabilities of the two kinds before it.
    """
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return toxicity.fit_chain(docs, labels, {"toxic_low_quality": bad & toxic, "toxic_good_quality": ~bad & toxic, "toxic": toxic}, "toxic")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_chain(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, i AS pos, ls[i] AS line FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), held AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone
  FROM keyed k LEFT JOIN held h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_by_source(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def mix_sql(docs: str) -> str:
    """SQL of the mix over a relation with doc_id, text and source."""
    return f"""
sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS lot FROM {docs}
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source IS NULL, source) AS r,
    sum(CAST(source_size AS DOUBLE)) OVER () * 1.5 AS total,
    coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_w
  FROM per_source
), level AS (
  SELECT min(r) AS first_free FROM ranked WHERE (total - capped) / free_w <= 2.0 * source_size / w
), targets AS (
  SELECT a.source, a.source_size,
    CASE WHEN a.r < first_free THEN 2.0 * a.source_size
         ELSE a.w * (b.total - b.capped) / b.free_w END AS target
  FROM ranked a CROSS JOIN level LEFT JOIN ranked b ON b.r = first_free
), ordered AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY lot, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
    + greatest(0, least(size, quota % source_size - ahead)) END AS BIGINT) AS taken
FROM ordered
"""


OP5_SQL = "WITH " + mix_sql("documents")


def op6_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.text_digests(table(spark, sf_dir, "documents"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time: the table has none, so page ids are dealt over the hours of 2024."""
    hours = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)) * 37, F.lit(8784))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.timestamp_seconds(F.lit(1704067200) + hours * 3600).alias("fetched")
    )


def url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed entries, and dated ones for every host of the pages and for some of their first folders.

    The hash of a host decides over its entries, so the list grows with the hosts.
    """
    fixed = spark.createDataFrame(URL_LIST, "key string, since string, action string").withColumn("since", F.to_timestamp("since"))
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select(url_lists.url_host(url).alias("host"), F.get(url_lists.path_segments(url_lists.url_path(url)), F.lit(0)).alias("folder"))
    rows = rows.where("host <> ''").withColumn("h", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")).distinct()

    def event(key: Column, days: Column, action: Column) -> Column:
        return F.struct(key.alias("key"), F.timestamp_seconds(F.lit(1704067200) + days * 86400).alias("since"), action.alias("action"))

    h = F.col("h")
    said = F.get(F.array(F.lit("block"), F.lit("review"), F.lit("allow")), h % 3)
    events = F.array_compact(
        F.array(
            event(F.col("host"), h % 200, said),
            F.when(h % 4 == 0, event(F.col("host"), h % 200 + 60, F.lit(url_lists.WITHDRAWN))),
            F.when((h % 5 < 2) & F.col("folder").isNotNull(), event(F.concat_ws("/", "host", "folder"), h % 100 + 31, F.lit("allow"))),
        )
    )
    return fixed.unionByName(rows.select(F.explode(events).alias("e")).select("e.*").distinct())


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_lists.judge(captures(spark, sf_dir), url_entries(spark, sf_dir))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return judged.select(
        "page_id",
        "url",
        "host",
        F.date_format("fetched", stamp).alias("fetched"),
        "list_key",
        F.date_format("list_since", stamp).alias("list_since"),
        "verdict",
    )


OP10_SQL = (
    "WITH fixed(key, since, action) AS (VALUES "
    + ", ".join(f"('{k}', TIMESTAMP '{t}', '{a}')" for k, t, a in URL_LIST)
    + r"""
), caps AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((coalesce(page_id, 0) * 37) % 8784 AS INTEGER)) AS fetched,
    rtrim(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
    regexp_replace(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*(/[^?#]*)', 1), '/+', '/', 'g') AS path FROM pages
), hosts AS (
  SELECT DISTINCT host, nullif(split_part(path, '/', 2), '') AS folder, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS h FROM caps WHERE host <> ''
), entries AS (
  SELECT * FROM fixed
  UNION ALL SELECT DISTINCT host, TIMESTAMP '2024-01-01 00:00:00' + to_days(h % 200), ['block', 'review', 'allow'][h % 3 + 1] FROM hosts
  UNION ALL SELECT DISTINCT host, TIMESTAMP '2024-01-01 00:00:00' + to_days(h % 200 + 60), 'withdraw' FROM hosts WHERE h % 4 = 0
  UNION ALL SELECT DISTINCT host || '/' || folder, TIMESTAMP '2024-01-01 00:00:00' + to_days(h % 100 + 31), 'allow' FROM hosts WHERE h % 5 < 2 AND folder IS NOT NULL
), latest AS (
  SELECT key, since, max(action) AS action FROM entries GROUP BY 1, 2
), spans AS (
  SELECT key, since, action, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM latest
), hits AS (
  SELECT c.page_id, c.url, c.fetched, s.key, s.since, s.action,
    row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched ORDER BY contains(s.key, '/') DESC, length(s.key) DESC) AS rn
  FROM caps c JOIN spans s ON s.action <> 'withdraw' AND c.fetched >= s.since AND (s.until IS NULL OR c.fetched < s.until)
    AND CASE WHEN contains(s.key, '/') THEN starts_with(c.host || c.path || '/', s.key || '/')
             ELSE ends_with('.' || c.host, '.' || s.key) END
)
SELECT c.page_id, c.url, c.host, strftime(c.fetched, '%Y-%m-%d %H:%M:%S') AS fetched, h.key AS list_key,
  strftime(h.since, '%Y-%m-%d %H:%M:%S') AS list_since, coalesce(h.action, 'none') AS verdict
FROM caps c LEFT JOIN hits h ON h.rn = 1 AND c.page_id IS NOT DISTINCT FROM h.page_id
  AND c.url IS NOT DISTINCT FROM h.url AND c.fetched = h.fetched
"""
)

OP7_SQL = r"""
WITH items AS (
  SELECT min(item_id) AS item_id, count(*) AS n_items, ws, least(5, len(ws)) AS k, len(ws) - least(5, len(ws)) + 1 AS n
  FROM (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM benchmark) WHERE ws[1] <> '' GROUP BY ws
), item_grams AS (
  SELECT item_id, n_items, k, n, s, count(*) AS weight FROM (
    SELECT item_id, n_items, k, n, unnest(list_transform(range(1, n + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS s FROM items) GROUP BY ALL
), docs AS (
  SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM documents
), grams AS (
  SELECT doc_id, k, len(ws) - k + 1 AS total, unnest(range(0, len(ws) - k + 1)) AS pos, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS s
  FROM docs CROSS JOIN (SELECT DISTINCT k FROM items) WHERE len(ws) >= k
), starts AS (
  SELECT g.doc_id, g.k, g.total, g.pos, i.item_id, i.n_items, i.n FROM grams g JOIN item_grams i ON i.k = g.k AND i.s = g.s
), counted AS (
  SELECT a.doc_id, a.item_id, a.n_items, a.n, a.pos, least(a.n, a.total - a.pos) AS size, a.k, g.s, count(*) AS held
  FROM starts a JOIN grams g ON g.doc_id IS NOT DISTINCT FROM a.doc_id AND g.k = a.k AND g.pos BETWEEN a.pos AND a.pos + a.n - 1 GROUP BY ALL
), shared AS (
  SELECT c.doc_id, c.item_id, c.n_items, c.n, c.pos, c.size, sum(least(c.held, i.weight)) AS common
  FROM counted c JOIN item_grams i ON i.item_id = c.item_id AND i.s = c.s GROUP BY ALL
), scored AS (
  SELECT *, common / (size + n - common) AS similarity FROM shared WHERE common / (size + n - common) >= 0.8
)
SELECT doc_id, item_id, n_items, CAST(min(pos) AS BIGINT) AS start_word, round(any_value(similarity), 6) AS similarity FROM (
  SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS top FROM scored) WHERE similarity = top GROUP BY doc_id, item_id, n_items
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON y.s = x.s AND y.doc_id <> x.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), classes AS (
  SELECT node, min(root) AS class_id FROM reach GROUP BY 1
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY 1
)
SELECT d.doc_id, c.class_id, coalesce(l.n, 0) AS n_links, c.class_id = d.doc_id AS keep
FROM documents d JOIN classes c ON c.node = d.doc_id LEFT JOIN counted l ON l.a = d.doc_id
"""


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def clusters_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """SQL of the clusters: each round is a pair of relations, the assignment and the means."""
    near = """a{i} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(c.n, (d, c.n)) AS cluster, min(d) AS distance FROM (
    SELECT x.rid, x.vec_id, x.v, c.n, list_sum(list_transform(list_zip(x.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x CROSS JOIN c{i} c) c
  GROUP BY rid, vec_id, v
)"""
    means = """m{i} AS (
  SELECT cluster, dim, sum(y) AS s, count(*) AS k FROM (SELECT cluster, unnest(v) AS y, unnest(range(0, {width})) AS dim FROM a{i}) GROUP BY 1, 2
), c{j} AS MATERIALIZED (
  SELECT c.n, coalesce(g.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % k + k) % k)) // k AS BIGINT) ORDER BY dim) AS c FROM m{i} GROUP BY 1) g ON g.cluster = c.n
)"""
    parts = [
        f"""WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
), c0 AS MATERIALIZED (
  SELECT n, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS n FROM x) WHERE n < {k}
)"""
    ]
    for i in range(rounds):
        parts += [near.format(i=i), means.format(i=i, j=i + 1, width=width)]
    parts.append(near.format(i=rounds))
    return ", ".join(parts) + f"""
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.n = a.cluster"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), docs AS (
  SELECT rid, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), asked AS (
  SELECT item_id, text, t, count(*) AS times FROM (
    SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), held AS (
  SELECT rid, doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, doc_id, n, unnest(ws) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM held GROUP BY t) CROSS JOIN totals
), scored AS (
  SELECT a.item_id, a.text, h.rid, h.doc_id,
    CAST(sum(a.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (100 - 75 + (75 * h.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN held h ON h.t = a.t JOIN weights w ON w.t = a.t CROSS JOIN totals GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_html_text": op2_html_text,
    "op3_pii": op3_pii,
    "op8_toxicity": op8_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mix": op5_source_mix,
    "op6_media_avi": op6_media_avi,
    "op7_decontam": op7_decontam,
    "op9_near_dups": op9_near_dups,
    "op10_url_lists": op10_url_lists,
    "op11_clusters": op11_clusters,
    "op12_packing": op12_packing,
    "op13_search": op13_search,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op5_source_mix": OP5_SQL,
    "op7_decontam": OP7_SQL,
    "op9_near_dups": OP9_SQL,
    "op10_url_lists": OP10_SQL,
    "op11_clusters": clusters_sql(),
    "op13_search": OP13_SQL,
}
