"""URL rules: host-suffix and path-prefix expressions joined on short hash prefixes.

Every url is expanded into host suffixes at dots times path prefixes at slashes, as deep as the deepest rule, which is
exact because no rule can match beyond. Url and rule meet on the first four bytes of a SHA-256 digest; the join then
confirms the whole digest and that the path starts with the rule's path. The longest rule (host and path) wins, then
the longer host, then the rule's text, then block before allow.

Null urls and urls without ``://`` have empty host and path and match nothing. Rules with a null or empty host, or with an
action other than allow and block, are ignored; a null rule path is empty. Repeated page rows stay as many rows. An
empty table gives no rows. No rule: ``default`` is the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common

# Fixed values of the contract: host, path, action.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
HASH_PREFIX_DIGITS = 8


def lower_ascii(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_suffixes(host: Column, most: Column) -> Column:
    """Suffixes of at most ``most`` labels: ``a.b.c`` gives ``c``, ``b.c``, ``a.b.c``."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), most)),
                       lambda n: F.array_join(F.slice(labels, -n, n), "."))


def path_prefixes(path: Column, most: Column) -> Column:
    """Prefixes that end in one of the first ``most`` slashes, and the empty one."""
    parts = F.split(path, "/")
    depth = F.least(F.size(parts) - 1, most)
    return F.transform(F.sequence(F.lit(0), depth), lambda n: F.when(n == 0, "").otherwise(
        F.concat(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/"), F.lit("/"))))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per rule with the digest of its host and of its path up to the last slash."""
    path = F.coalesce(F.col("path"), F.lit(""))
    anchor = F.regexp_extract(path, r"(?s)^(.*/)?", 1)
    return rules.select(lower_ascii(F.col("host")).alias("rule_host"), path.alias("rule_path"), F.col("action").alias("action")).where(
        (F.col("rule_host") != "") & F.col("action").isin("allow", "block")).distinct().select(
        "*", F.sha2(F.concat(F.col("rule_host"), F.lit("\n"), F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1)), 256).alias("rule_digest"),
        F.size(F.split("rule_host", r"\.")).alias("labels"),
        (F.size(F.split("rule_path", "/")) - 1).alias("slashes")).withColumn(
        "rule_key", F.substring("rule_digest", 1, HASH_PREFIX_DIGITS))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page row: page_id, url, host, path, rule and verdict.

    Equal rows are counted first, so that a url holding much of the table is expanded once per id; rules are
    joined by whatever strategy their size allows."""
    known = prepared_rules(rules)
    deepest = known.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).groupBy(
        "page_id", "url").agg(F.count("*").alias("copies"))
    rows = rows.withColumns({"host": F.coalesce(url_host(F.col("url")), F.lit("")), "path": F.coalesce(url_path(F.col("url")), F.lit(""))})
    most = deepest.first()  # two numbers
    expressions = rows.where(F.col("host") != "").select("page_id", "url", "path", F.explode(host_suffixes(
        F.col("host"), F.lit(max(most["labels"], 1)))).alias("suffix")).select(
        "page_id", "url", "path", F.col("suffix"), F.explode(path_prefixes(F.col("path"), F.lit(most["slashes"]))).alias("prefix"))
    expressions = expressions.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)).withColumn(
        "key", F.substring("digest", 1, HASH_PREFIX_DIGITS))
    matched = expressions.join(known, F.col("key") == F.col("rule_key")).where(
        (F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = matched.groupBy("page_id", "url").agg(F.max(F.struct(
        F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), (F.col("action") == "block").alias("blocks"), F.col("action"))).alias("best")).select(
        F.col("page_id").alias("best_id"), F.col("url").alias("best_url"), "best")
    same = F.col("page_id").eqNullSafe(F.col("best_id")) & (F.col("url") == F.col("best_url"))
    judged = rows.join(best, same, "left").select(
        "page_id", "url", "host", "path", "copies", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def url_verdicts(spark, folder: str) -> DataFrame:
    """Query op5: verdict of every page under the fixed rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(common.table(spark, folder, "pages"), rules).drop("url")
