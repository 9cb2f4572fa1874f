"""Longest-match URL rules by a sort-merge range join."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm.common import pin, table

# The rules of the query, (action, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot: a rule's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rules and urls in order of key. The stack holds the hosts whose interval is open, outermost first;
    an entry has the host's key and its rules by path, with the path lengths that occur."""
    stack: list[tuple[str, dict[str, tuple[str, str]], set[int]]] = []
    part = None
    for frame in frames:
        out = []
        for at, key, is_url, page, path, rule, action in zip(
            frame["part"], frame["key"], frame["is_url"], frame["row"], frame["path"], frame["rule"], frame["action"]
        ):
            if at != part:
                stack, part = [], at
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                stack[-1][1].setdefault(path, (rule, action))
                stack[-1][2].add(len(path))
                continue
            best = None
            for _, paths, sizes in stack:
                for n in sizes:
                    hit = paths.get(path[:n]) if n <= len(path) else None
                    if hit and (best is None or len(hit[0]) >= len(best[0])):
                        best = hit
            if best:
                out.append((page, *best))
        yield pd.DataFrame(out, columns=["row", "rule", "action"]).astype({"row": "int64"})


def apply_rules(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Each row of ``urls`` with host, path, rule and verdict (these names are replaced if they exist).

    A rule fits its host and all subdomains where the url's path starts with the rule's; of the fitting
    rules the longest (host and path together; of equally long ones that with the longer host) decides,
    otherwise ``default``. A null url has empty host and path and fits no rule; rules with a null part
    are no rules; of rules with equal host and path the smallest action counts; an empty table gives none.

    A rule's host key is the interval of keys that start with it. Distinct (host, path) pairs are dealt
    out by ranges of (key, path), so a host with a third of all rows is one row per path and may
    lie in several ranges; the layout is pinned, a rule is sent to the ranges that its interval meets
    (found among one pair of bounds per range), and each range is swept in order with a stack.
    """
    host, path = url_parts(F.col(url))
    parts = urls.withColumns({"host": host, "path": path})
    rules = (
        rules.where("host is not null and path is not null and action is not null")
        .groupBy("host", "path").agg(F.min("action").alias("action"))
        .select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "action")
    )
    points = pin(
        parts.select("host", "path").distinct()
        .withColumn("key", host_key(F.col("host")))
        .repartitionByRange("key", "path").sortWithinPartitions("key", "path")
        .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    )
    # One row per range of the layout: as many as there are partitions.
    bounds = sorted(
        (r["lo"], r["hi"], r["part"])
        for r in points.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    )
    lows, highs, ids = [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds]

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Keys that start with k lie from k up to, not including, k with its last dot raised by one.
            frame["part"] = [
                ids[bisect_left(highs, k):bisect_left(lows, k[:-1] + "/")] for k in frame["key"]
            ]
            yield frame.explode("part").dropna(subset=["part"]).astype({"part": "int32"})

    placed = rules.mapInPandas(ranges, "key string, path string, rule string, action string, part int")
    swept = (
        points.select("part", "key", F.lit(True).alias("is_url"), "row", "path",
                      F.lit("").alias("rule"), F.lit("").alias("action"))
        .unionByName(placed.withColumns({"is_url": F.lit(False), "row": F.lit(-1).cast("long")}))
        .repartition("part").sortWithinPartitions("part", "key", "is_url", "path")
        .mapInPandas(_sweep, "row long, rule string, action string")
    )
    decided = points.join(swept, "row").select("host", "path", "rule", "action")
    return (
        parts.join(decided.withColumnsRenamed({"host": "_host", "path": "_path", "rule": "_rule", "action": "_action"}),
                   (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
        .withColumns({"rule": F.col("_rule"), "verdict": F.coalesce("_action", F.lit(default))})
        .drop("_host", "_path", "_rule", "_action")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; without a fitting rule it is allowed.

    A null url, or one without ``://``, has empty host and path and no rule. Of several fitting rules the longest (host and path) wins; two
    of them can't be equally long, as both fit one url. Repeated rows are judged alike, null page_ids kept; other columns
    are not read; an empty table gives no rows.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return apply_rules(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                    ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
rest AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS r FROM pages),
split AS (SELECT page_id, regexp_extract(r, '^[^/?#]*', 0) AS host, r FROM rest),
parts AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(r, length(host) + 1), '^[^?#]*', 0) AS path FROM split),
fits AS (SELECT parts.page_id, parts.host, parts.path, h || p AS rule, action
         FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
       coalesce(arg_max(action, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
"""
