"""URL filters by host-suffix and path-prefix expressions.

A URL is expanded to host suffixes (at label borders, of as many labels as rules have) times path prefixes (of the lengths that
rules have), so that a host of many labels costs no more than another; expressions and rules are joined on the first bytes of their SHA-256, the full digests then confirm, and of the
rules that fit the longest wins (a block before an allow of the same length). Rules are joined to the different
(host, path) pairs; how the smaller side travels is left to Spark, which checks its size.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits; repeated rows
are judged each; very long hosts and paths are judged whole; of equally long rules the one with the longer host wins, of
the same expression given twice the block; columns other than the key and the URL are ignored; empty tables on either side are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: str) -> Column:
    """How many labels a host column has."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(df: DataFrame) -> DataFrame:
    """(host, path, verdict) with digests."""
    whole = F.sha2(F.concat("host", F.lit("\x00"), "path"), 256)
    return df.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", whole.alias("rule_digest"), F.substring(whole, 1, PREFIX_HEX).alias("rule_prefix"))


def verdicts(df: DataFrame, rules: DataFrame | None = None, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of each row; rules: (host, path, verdict), ``RULES`` if none are given."""
    spark = df.sparkSession
    known = rule_table(rules if rules is not None else spark.createDataFrame(list(RULES), "host string, path string, verdict string"))
    rows = df.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # a number of tasks is named, so that the few bytes of many pairs, from which the expressions grow, stay spread
    pairs = rows.select("host", "path").filter("host <> ''").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "path").distinct()
    lengths = known.agg(F.sort_array(F.collect_set(F.length("rule_path")))).scalar()
    counts = known.agg(F.sort_array(F.collect_set(labels_of("rule_host")))).scalar()
    shapes = pairs.select("host", "path", labels_of("host").alias("labels"), counts.alias("counts"), lengths.alias("lengths"))
    expressions = shapes.select("host", "path", "lengths", F.explode(F.expr("filter(counts, c -> c <= labels)")).alias("c")).select(
        "host", "path", F.expr("substring_index(host, '.', -c)").alias("h"), F.explode(F.expr("filter(lengths, n -> n <= length(path))")).alias("n")
    )
    digest = F.sha2(F.concat("h", F.lit("\x00"), F.expr("substring(path, 1, n)")), 256)
    sent = expressions.select("host", "path", digest.alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    met = sent.join(known, (F.col("prefix") == F.col("rule_prefix")) & (F.col("digest") == F.col("rule_digest")))
    name = F.concat("rule_host", "rule_path")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), F.length("rule_host").alias("m"), F.col("verdict"), name.alias("rule"))).alias("best"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best.rule", "best.verdict")
    out = rows.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return out.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
