"""URL filters by host-suffix and path-prefix expressions.

A URL is expanded into expressions ``host suffix + path prefix``. Rules and expressions meet in an equi-join on the first four bytes of a SHA-256
digest; the full digest is then compared, and of the rules that remain the longest one decides. Only such host suffixes and path prefixes are made as some
rule has (by number of labels and by length), so a URL has at most labels x lengths expressions, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rules are broadcast (about 200 bytes each); more are joined by a shuffle.
MAX_BROADCAST_RULES = 100_000


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A table (verdict, host, path) of the rows as literals; large rule sets are read from a table of these columns instead."""
    names = ("verdict", "host", "path")
    rows = [F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(names, r, strict=True)]) for r in rules]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(n) for n in names])
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_parts(urls: DataFrame) -> DataFrame:
    """``urls`` with ``host`` and ``path``; both are empty for null urls and those without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.when(F.col("url").contains("://"), F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return (
        urls.withColumn("__rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), upper, lower))
        .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("__rest")
    )


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``urls`` (with a column url) with host, path, rule and verdict; columns of these names are replaced.

    Equal rows stay apart and are judged alike. The verdict is the rule's, or ``default`` where no rule fits, which is so for every null url. Of the rules that
    fit, the longest (host and path together) wins, of equally long ones that with the longer host, and block before allow where the same rule has both. Rules with a
    null or empty host or a null path fit nothing.
    """
    rules = rules.where((F.col("host") != "") & F.col("path").isNotNull()).select(F.col("verdict"), F.col("host"), F.col("path")).distinct()
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    rules = rules.select(
        F.substring(_digest(F.col("host"), F.col("path")), 1, 8).alias("__prefix"),
        _digest(F.col("host"), F.col("path")).alias("__rule_digest"),
        F.struct(
            (F.char_length("host") + F.char_length("path")).alias("size"), F.char_length("host").alias("host_size"), F.col("verdict").alias("verdict"), F.concat("host", "path").alias("rule")
        ).alias("__fit"),
    )
    if shape["n"] <= MAX_BROADCAST_RULES:
        rules = F.broadcast(rules)
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    named = url_parts(urls.drop("host", "path", "rule", "verdict")).withColumn("__row", F.monotonically_increasing_id())
    own = [c for c in named.columns if c != "__row"]
    suffixes = F.filter(F.array(*[F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in labels]).cast("array<string>"), lambda x: x.isNotNull() & (x != ""))
    prefixes = F.filter(F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>"), lambda x: x.isNotNull())
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    expanded = named.withColumn("__digest", F.explode_outer(digests)).withColumn("__prefix", F.substring("__digest", 1, 8))
    fits = expanded.join(rules, "__prefix", "left").withColumn("__fit", F.when(F.col("__digest") == F.col("__rule_digest"), F.col("__fit")))
    best = fits.groupBy("__row").agg(*[F.first(c).alias(c) for c in own], F.max("__fit").alias("__fit"))
    return best.select(*own, F.col("__fit.rule").alias("rule"), F.coalesce(F.col("__fit.verdict"), F.lit(default)).alias("verdict"))
