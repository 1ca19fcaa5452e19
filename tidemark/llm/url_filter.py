"""URL filters: host-suffix and path-prefix expressions of each URL, joined to a rule list by short digest prefixes.

DataFrame functions only. A rule is (action, host, path). It fits its host and all subdomains if the URL's path starts
with the rule's path. Of the fitting rules the longest (host and path together) wins; of equally long ones that with the
longer host, then block before allow.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule. URLs may be of any length; a
URL is expanded into its host suffixes times the lengths of the rules' paths. Repeated URLs get equal verdicts. Where no rule
fits, the verdict is `default`. An empty table gives an empty result; an empty rule list gives every URL the default verdict.
Columns of the input are kept, whatever their names; the four added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, quoted

#: The rules of the registered query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PREFIX = 8  # hex digits of the digest that the first join compares


def host_and_path(url: Column) -> tuple[Column, Column]:
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The rules with the digest of their expression; repeated rules count once, block before allow."""
    df = spark.createDataFrame([tuple(r) for r in rules], "action string, rule_host string, rule_path string")
    df = df.groupBy(F.translate("rule_host", _UPPER, _LOWER).alias("rule_host"), "rule_path").agg(F.max("action").alias("action"))
    return with_digest(df, F.col("rule_host"), F.col("rule_path"))


def with_digest(df: DataFrame, host: Column, path: Column) -> DataFrame:
    digest = F.sha2(F.concat(host, F.lit("\x00"), path), 256)
    return df.withColumn("digest", digest).withColumn("digest_prefix", F.substring("digest", 1, _PREFIX))


def expressions(urls: DataFrame, lengths: Column) -> DataFrame:
    """A row per host suffix (at label borders) and path prefix of each of `lengths` characters."""
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    df = urls.withColumn("expr_host", F.explode(F.array_distinct(suffixes))).withColumn("expr_path", F.explode(F.array_distinct(prefixes)))
    return with_digest(df, F.col("expr_host"), F.col("expr_path"))


def url_filter(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (its text, or null) and verdict.

    rules: rule_table()'s columns, of any size: it is joined by a shuffle unless Spark's own size check lets it broadcast
    it. Distinct URLs are judged once, so a URL that many rows share is neither expanded nor joined for each of them.
    """
    own = free_name(df.columns, "own_url")
    host, path = host_and_path(F.col(own))
    given = F.coalesce(quoted(url), F.lit("")).alias(own)
    lengths = rules.select(F.length("rule_path").alias("n")).distinct().agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    parsed = df.select(given).distinct().select(own, host.alias("host"), path.alias("path"))
    candidates = expressions(parsed.crossJoin(F.broadcast(lengths)).where("host <> ''"), F.col("lengths"))
    found = candidates.alias("e").join(rules.alias("r"), F.col("e.digest_prefix") == F.col("r.digest_prefix"))
    found = found.where("e.digest = r.digest and e.expr_host = r.rule_host and e.expr_path = r.rule_path")
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("action"), F.concat("rule_host", "rule_path").alias("rule"))
    best = found.groupBy(own).agg(F.max(order).alias("best"))
    judged = parsed.join(best, own, "left").select(own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return df.select(*map(quoted, kept), given).join(judged, own, "left").drop(own)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH rules(action, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
numbered AS (SELECT *, row_number() OVER () AS k FROM parsed),
best AS (
  SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule,
         arg_max(action, length(rule_host || rule_path) * 1000 + length(rule_host)) AS action
  FROM numbered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM numbered LEFT JOIN best USING (k)
"""
