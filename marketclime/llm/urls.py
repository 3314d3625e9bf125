"""URL filters: host-suffix and path-prefix expressions against a rule list, by hash prefix and then full digest.

Column functions only. Rules are a table of any size; Spark broadcasts it where
its size is below the session's threshold and shuffles beyond, where adaptive
execution splits hot expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8  # hex digits of the digest that the equi-join is on


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, expression), an expression being a host, then a path from its first ``/`` on."""
    rows = spark.createDataFrame(list(rules), "verdict string, rule string")
    return rows.select("rule", "verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: ``key``, host, path, rule (null where none fits) and verdict.

    ``rules`` has rule and verdict (allow or block). A rule fits its host and
    every subdomain where the path starts with the rule's path. The longest
    rule wins; between equals the longer host, then block. Null urls have an
    empty host and path, which fit no rule; rows with a null or repeated key
    stay rows of their own; no rules leave the default everywhere.

    Every url is expanded into its host suffixes times those path prefixes
    whose length some rule has; the lengths are read first (at most one number
    per length of a path in the list).
    """
    parts = rules.select(
        "rule",
        "verdict",
        F.substring_index("rule", "/", 1).alias("_host"),
        F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("_path"),
    ).filter(F.col("rule").isNotNull() & F.col("verdict").isNotNull())
    lengths = sorted(r[0] for r in parts.select(F.length("_path")).distinct().collect())
    digest = F.sha2(F.concat_ws("\n", "_host", "_path"), 256)
    listed = parts.select(
        F.substring(digest, 1, PREFIX).alias("_prefix"),
        digest.alias("_digest"),
        F.struct(
            F.length("rule").alias("length"),
            F.length("_host").alias("host_length"),
            (F.col("verdict") == "block").alias("blocks"),
            "rule",
            "verdict",
        ).alias("_rule"),
    )
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key),
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
    )
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wanted = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    prefixes = F.transform(
        F.filter(wanted, lambda n: n <= F.length("path")), lambda n: F.expr("path").substr(F.lit(1), n)
    )
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", h, p), 256))))
    asked = rows.select("*", F.explode_outer(pairs).alias("_asked"))
    asked = asked.withColumn("_start", F.substring("_asked", 1, PREFIX))
    found = asked.join(listed, (F.col("_start") == F.col("_prefix")) & (F.col("_asked") == F.col("_digest")), "left")
    best = found.groupBy("_row").agg(
        F.first(key).alias(key), F.first("host").alias("host"), F.first("path").alias("path"), F.max("_rule").alias("_rule")
    )
    return best.select(
        key,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"),
    )
