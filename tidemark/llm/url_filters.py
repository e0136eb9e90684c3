"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes.

Every distinct url is expanded into host suffix + path prefix expressions, only
for the label counts and path lengths that some rule has. The first four bytes
of each expression's SHA-256 are joined with those of the rules; the full
digests confirm a hit, and the longest rule wins. Nothing but DataFrame
expressions is used. The rule table is an ordinary join side: Spark broadcasts
it when its size is below the session's threshold and sorts both sides beyond.
Distinct urls are judged once, so a url that fills a third of the table costs
one expansion; the join back on the url can be split by adaptive execution.

A null url, or one without ``://``, has an empty host and path and fits no
rule. Rows are returned as often as they occur; a column with the name of a
result is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as (verdict, host, path) rows with their digests."""
    df = spark.createDataFrame(list(rules), "rule_verdict string, rule_host string, rule_path string")
    return with_digests(df)


def with_digests(rules: DataFrame) -> DataFrame:
    rule = F.concat("rule_host", "rule_path")
    return rules.withColumns({"rule": rule, "digest": F.sha2(rule, 256), "n_labels": F.size(F.split("rule_host", r"\.")), "n_path": F.length("rule_path")}).withColumn("short", F.substring("digest", 1, 8))


def expressions(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Host suffixes of the given label counts, each with the path prefixes of the given lengths."""
    suffixes = [F.when(F.size(F.split(host, r"\.")) >= n, F.substring_index(host, ".", -n)) for n in labels]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    pairs = [F.concat(s, p) for s in suffixes for p in prefixes]
    return F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    ``rules`` comes from ``rule_table`` or ``with_digests``. Only its distinct
    label counts and path lengths are read on the driver (a few numbers). Of
    rules with equal text the blocking one wins.
    """
    kinds = rules.select("n_labels", "n_path").distinct().collect()
    labels, lengths = sorted({r.n_labels for r in kinds}), sorted({r.n_path for r in kinds})
    seen = pages.select(F.col(url).alias("_url")).where(F.col(url).contains("://")).distinct()
    expanded = seen.select("_url", F.explode(F.array_distinct(expressions(host_of(F.col("_url")), path_of(F.col("_url")), labels, lengths))).alias("_e"))
    hashed = expanded.select("_url", F.sha2("_e", 256).alias("_d")).withColumn("short", F.substring("_d", 1, 8))
    hits = hashed.join(rules.select("short", "digest", "rule", "rule_verdict"), "short").where(F.col("_d") == F.col("digest"))
    order = F.struct(F.length("rule"), (F.col("rule_verdict") == "block"), F.col("rule"))
    key, found = fresh(pages, "_url"), fresh(pages, "_best")
    best = hits.groupBy(F.col("_url").alias(key)).agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias(found))
    out = pages.join(best, F.col(url) == F.col(key), "left").drop(key)
    rule = F.col(found)
    return out.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "rule": rule["rule"], "verdict": F.coalesce(rule["rule_verdict"], F.lit(default))}).drop(found)
