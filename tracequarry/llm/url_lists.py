"""URL filtering against dated lists, as native DataFrame operations.

List entries are dated events ("from this time the key is blocked / allowed / withdrawn"). They
become validity intervals per key, and an as-of join evaluates each capture against the entries
active when it was fetched. A key is a host suffix (``example.com``) or a host with a leading
path (``example.com/a/b``); the most specific active key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.llm.naming import quoted, unused
from tracequarry.session import staged

WITHDRAWN = "withdraw"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dots; '' if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def normal_key(key: Column) -> Column:
    """Host in lower case without final dots, path segments joined by single slashes."""
    host = F.regexp_replace(F.lower(F.split_part(key, F.lit("/"), F.lit(1))), r"\.+$", "")
    rest = path_segments(F.regexp_extract(key, "^[^/]*(/.*)?$", 1))
    return F.array_join(F.concat(F.array(host), rest), "/")


def validity(entries: DataFrame) -> DataFrame:
    """(key, since, action) events to (key, action, since, until); until is null while open.

    Null keys, times or actions are left out. Of events of one key and time the action that comes
    last by name holds. Withdrawn stretches yield no interval. Repeated events count once.
    """
    latest = (
        entries.where(F.col("key").isNotNull() & F.col("since").isNotNull() & F.col("action").isNotNull())
        .groupBy(normal_key(F.col("key")).alias("key"), "since")
        .agg(F.max("action").alias("action"))
    )
    by_key = Window.partitionBy("key").orderBy("since")
    return latest.withColumn("until", F.lead("since").over(by_key)).where(F.col("action") != WITHDRAWN)


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """All rows and columns of ``captures`` plus host, list_key, list_since and verdict.

    Urls and times are judged once per distinct pair, so repeated captures of a hot page cost one
    lookup; the verdict is joined back. A url of any length is asked for the keys that can cover it
    and no others: host suffixes of as many labels as some entry has, and path prefixes as deep as
    some entry of its host. Null urls or times, urls without a host and urls no active entry covers
    get the verdict 'none'; without entries all do. Columns of ``captures`` called host, list_key,
    list_since or verdict are replaced; no other name clashes. The list has any size: intervals,
    depths and verdicts are tables of their own, broadcast only where their size permits, else
    shuffled, and then a hot host, suffix or page can be split.
    """
    url, time = quoted(url_col), quoted(time_col)
    labels, segments = F.split("host", r"\."), path_segments(F.col("path"))
    spans = staged(
        validity(entries)
        .withColumns({"host": F.split_part("key", F.lit("/"), F.lit(1)), "depth": F.size(F.split("key", "/")) - 1})
        .withColumn("labels", F.size(labels)),
        "url-spans",
    )
    counts = sorted(r[0] for r in spans.where("depth = 0").select("labels").distinct().collect())  # few: names have few labels
    depths = staged(spans.where("depth > 0").groupBy("host").agg(F.collect_set("depth").alias("depths")), "url-depths")
    asked = captures.select(url.alias("url"), time.alias("time")).distinct()
    asked = asked.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))}).where("host <> '' and time is not null")
    met = asked.join(depths, "host", "left").withColumns({"__labels": labels, "__segments": segments})
    suffixes = F.transform(
        F.filter(F.array(*(F.lit(n) for n in counts)).cast("array<int>"), lambda n: n <= F.size("__labels")),
        lambda n: F.array_join(F.slice("__labels", F.size("__labels") - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.coalesce("depths", F.array().cast("array<int>")), lambda n: n <= F.size("__segments")),
        lambda n: F.concat("host", F.lit("/"), F.array_join(F.slice("__segments", F.lit(1), n), "/")),
    )
    keyed = met.select("url", "time", F.explode(F.concat(prefixes, suffixes)).alias("key"))
    hits = staged(
        keyed.join(spans, "key")
        .where((F.col("time") >= F.col("since")) & (F.col("until").isNull() | (F.col("time") < F.col("until"))))
        .groupBy("url", "time")
        .agg(F.max(F.struct("depth", "labels", "key", "since", "action")).alias("hit")),  # paths first, then long suffixes
        "url-hits",
    )
    names = unused(captures, "url", "time", "hit")
    hits = hits.select(*(F.col(c).alias(n) for c, n in zip(("url", "time", "hit"), names, strict=True)))
    out = captures.join(hits, url.eqNullSafe(F.col(names[0])) & time.eqNullSafe(F.col(names[1])), "left")
    hit = F.col(names[2])
    added = {
        "host": url_host(url),
        "list_key": hit["key"],
        "list_since": hit["since"],
        "verdict": F.coalesce(hit["action"], F.lit("none")),
    }
    return out.select(*(quoted(c) for c in captures.columns if c.lower() not in added), *(v.alias(k) for k, v in added.items()))
