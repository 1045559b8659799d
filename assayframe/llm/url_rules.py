"""URL filtering with hashed host-suffix and path-prefix expressions.

Each URL is expanded into expressions "host suffix + path prefix".  Those whose
short hash prefix equals that of a rule's expression are candidates (an
equi-join on that prefix), the full SHA-256 digests confirm them, and of a URL's
confirmed rules the longest wins.  All of it is DataFrame expressions.

A rule ``host/path`` fits its host and every subdomain when the URL's path
starts with the rule's path.  An expression can only meet a rule if its host has
as many labels and its path as many characters as some rule has, so expansion is
held to the label counts and path lengths that occur among the rules; no match
is lost by that, and a URL of a million dots costs no more than another.

Defined results: a null URL, or one without ``://``, has an empty host and path,
which no rule fits; without a rule the verdict is ``default``.  Rules given twice
count once; of an allow and a block rule with one expression, block wins.
Repeated rows are judged each for itself; an empty table, or none but other
columns' names clashing, changes nothing: only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: Up to so many rules are sent to every executor; more are shuffled to the URLs' expressions.
BROADCAST_RULES = 100_000
#: Hexadecimal digits of a digest that make the short hash: 4 bytes.
SHORT = 8


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Rules (verdict, host, path) with digest and short hash, each expression once."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    host = lower_ascii(F.col("host"))
    return (
        rules.groupBy(host.alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(
            F.concat("rule_host", "rule_path").alias("rule"),
            "rule_verdict",
            _digest(F.col("rule_host"), F.col("rule_path")).alias("digest"),
            F.size(F.split("rule_host", "[.]")).alias("labels"),
            F.length("rule_path").alias("path_length"),
        )
        .withColumn("short", F.substring("digest", 1, SHORT))
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", host, path), 256)


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Returns id, host, path, rule (the winner's expression, else null) and verdict, a row for each row of ``urls``."""
    shape = rules.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths"), F.count(F.lit(1)).alias("n")).first()
    rules = F.broadcast(rules) if shape["n"] <= BROADCAST_RULES else stored(rules, "url-rules")
    base = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    base = base.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.array(*map(F.lit, sorted(shape["labels"]))).cast("array<int>")
    lengths = F.array(*map(F.lit, sorted(shape["lengths"]))).cast("array<int>")
    own = F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", "[.]")))
    suffixes = F.transform(F.filter(labels, lambda n: n <= own), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    expressions = base.select("*", F.explode_outer(digests).alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    met = expressions.join(rules, "short", "left")
    sure = F.when(F.col("full") == F.col("digest"), F.struct(F.length("rule").alias("n"), "rule", "rule_verdict"))
    return (
        met.groupBy("row", "id", "host", "path")
        .agg(F.max(sure).alias("best"))
        .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
    )
