"""URL filter: host-suffix and path-prefix expressions against hashed rules.

Every URL is expanded into the expressions a rule could be written as (its host and each parent
domain, joined to path prefixes). Expressions meet rules by an equi-join on the first 32 bits of
their SHA-256; the full digest confirms the match; of the rules that fit, the longest decides
(then the longer host, then block over allow).

Only expressions that some rule could equal are made: suffixes with at most as many labels as the
longest rule host, prefixes of lengths that occur among rule paths. The lookups are the distinct
(host, path start) pairs, folded before the shuffle, so a hot host costs one lookup and its rows
find the answer by a join that adaptive execution can split. Rule and answer tables are broadcast
only where Spark's own size threshold allows it.

Defined cases: a null url or one without `://` has empty host and path and gets the default; an
empty host fits no rule; repeated page ids and rows are judged one by one; other columns of the
input are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import text_or_empty

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH_PREFIX_HEX = 8

#: (host, path, verdict): the rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_host(url: Column | str) -> Column:
    return F.translate(F.regexp_extract(text_or_empty(url), URL_PARTS, 1), UPPER, LOWER)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(url), URL_PARTS, 2)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _expressions(host: Column, path: Column, labels_most: int, path_lengths: list[int]) -> Column:
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.greatest(n - labels_most, F.lit(0)) + 1, n),
        lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in path_lengths]),
                        lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (`host/path` of the deciding rule or null), verdict."""
    shape = rules.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("labels"),
                      F.collect_set(F.length("path")).alias("lengths")).first()
    lengths = sorted(shape["lengths"])  # at most as many as the longest rule path has characters
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(url_col).alias("host"), url_path(url_col).alias("path"))
    start = F.substring("path", 1, max([0, *lengths]))
    if not lengths:
        return parts.select(F.col("page_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"),
                            F.lit(default).alias("verdict"))
    lookups = parts.where(F.col("host") != "").select("host", start.alias("start")).distinct()
    asked = (lookups.select("host", "start", F.explode(_expressions(F.col("host"), F.col("start"), shape["labels"], lengths)).alias("expr"))
             .select("host", "start", F.sha2("expr", 256).alias("digest"))
             .withColumn("prefix", F.substring("digest", 1, HASH_PREFIX_HEX)))
    rule = F.concat("host", "path")
    known = (rules.select(F.sha2(rule, 256).alias("rule_digest"), rule.alias("rule"),
                          F.length("host").alias("host_length"), "verdict")
             .withColumn("prefix", F.substring("rule_digest", 1, HASH_PREFIX_HEX)))
    best = F.max(F.struct(F.length("rule").alias("length"), "host_length", (F.col("verdict") == "block").alias("blocks"),
                          "rule", "verdict")).alias("best")
    answers = (asked.join(known, "prefix").where(F.col("digest") == F.col("rule_digest"))
               .groupBy("host", "start").agg(best)
               .select("host", "start", "best.rule", "best.verdict"))
    return (parts.withColumn("start", start).join(answers, ["host", "start"], "left")
            .select(F.col("page_id").alias(id_col), "host", "path", "rule",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), rules_frame(spark))


OP6_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), j AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
         END AS rule
  FROM u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
