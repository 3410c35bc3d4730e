"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.session import workspace


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("root"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link (a, b) to another; the component is its smallest node.

    Each round is one written table, so nothing of it is computed twice and a lost executor loses no round. Links of a
    node to itself and repeated links count once. The number of rounds is logarithmic in the size of a component.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        path = workspace(spark, "links")
        edges.write.parquet(path)
        stars = spark.read.parquet(path)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("root").alias("v")).distinct()
        # every row of large has u > v, as a small-star step wants it
        rooted = large.join(_nearest(large), "u")
        edges = rooted.select("u", F.col("root").alias("v")).unionByName(rooted.where("v <> root").select(F.col("v").alias("u"), F.col("root").alias("v"))).distinct()
