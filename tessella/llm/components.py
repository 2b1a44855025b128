"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Each node u hands its least neighbour (or itself) to its larger (``large``) or its not larger neighbours."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
    return joined.select("v", "m").union(least.select("u", "m")).toDF("u", "v").where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of ``links`` (a, b: longs, not null). The number of rounds is logarithmic; each is written to the shared folder."""
    edges = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    while True:
        stars = staged(_stars(_stars(edges, True), False), "links")
        discard(edges)
        edges = stars
        # Every node but the least points at its component once nothing changes.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
