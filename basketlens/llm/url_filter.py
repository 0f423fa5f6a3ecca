"""URL filters by host-suffix and path-prefix expressions (operator 7).

Every URL is expanded into the expressions ``host suffix + path prefix`` that a
rule could equal, the expressions meet the rules in an equi-join on a short hash
prefix, and the full SHA-256 digest confirms each match.  Of all confirmed rules
the longest wins.  Built-in functions only.

Only the suffix label counts and prefix lengths that occur among the rules are
expanded, so a host of 100,000 labels or a path of 100,000 characters gives as
few expressions as a short one.  Distinct (host, path) pairs are judged once and
joined back, so a hot host costs one judgement; the join back is a left join
whose large side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_SCHEMA = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("verdict", T.StringType()),
])

#: The rules of the registered query: fixed values.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
                       UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def short_hash(full: Column) -> Column:
    """The first 32 bits of a digest, the join key."""
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("long")


def _shape(rules: DataFrame) -> tuple[list[int], list[int]]:
    """Label counts of the rules' hosts and lengths of their paths: two short lists of numbers."""
    one = rules.agg(F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
                    F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    return one["labels"], one["lengths"]


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of ``(host, path)`` expressions of a URL, each at most once."""
    out = []
    for k in labels:
        suffix = F.substring_index(host, ".", -k)
        # fewer labels than k: substring_index gives the whole host again
        whole = F.size(F.split(host, r"\.", k + 1)) >= k
        for n in lengths:
            out.append(F.when(whole & (F.length(path) >= n),
                              F.struct(suffix.alias("host"), F.substring(path, 1, n).alias("path"))))
    return F.array_compact(F.array(*out))


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row of ``pages``.

    A rule ``(host, path, verdict)`` fits its host and all subdomains when the URL's
    path starts with the rule's path; the rule with most characters wins (at equal
    length the longer host, then the smaller path; of rules with equal host and path
    the smallest verdict).  Without a rule, ``rule`` is NULL and the verdict is
    ``default``.  A NULL URL, or one without ``://``, has empty host and path.  Rows
    may repeat and ids may be NULL: a row out for each row in.  An empty rule table
    gives the default everywhere; other columns are not read.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"),
                         F.coalesce("path", F.lit("")).alias("path"), "verdict") \
                 .where(F.col("host").isNotNull() & (F.col("host") != "")) \
                 .groupBy("host", "path").agg(F.min("verdict").alias("rule_verdict"))
    labels, lengths = _shape(rules)
    # coalesce keeps the plan the same for a rule with a NULL verdict: the default holds
    rules = rules.withColumn("rule_digest", digest(F.col("host"), F.col("path"))).select(
        short_hash(F.col("rule_digest")).alias("short"), "rule_digest",
        F.struct((F.length("host") + F.length("path")).alias("chars"),
                 F.length("host").alias("host_chars"),
                 F.concat("host", "path").alias("rule"),
                 F.coalesce("rule_verdict", F.lit(default)).alias("verdict")).alias("fit"))

    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path"))
    if not labels:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    expanded = urls.select("host", "path").distinct().select(
        "host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("e")
    ).withColumn("url_digest", digest(F.col("e.host"), F.col("e.path"))) \
        .withColumn("short", short_hash(F.col("url_digest")))
    best = (expanded.join(rules, "short")
            .where(F.col("url_digest") == F.col("rule_digest"))
            .groupBy("host", "path").agg(F.max("fit").alias("fit")))
    return urls.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))


def fixed_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


#: DuckDB SQL of the registered query.
SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM r
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
       coalesce((SELECT rverdict FROM r
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""
