"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _low(edges: DataFrame) -> DataFrame:
    """(node, low): the smallest id among a node and its neighbours. A partial minimum goes before the shuffle, so a hub costs no more than others."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("low"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): node, component; component is the smallest id that the node reaches.

    Nulls and loops are left out (a node with no other edge has no row); repeated edges count once. No rows in, no rows
    out. Each half round is one groupBy-min and one join on the node (both sides shuffled by it, so that adaptive
    execution splits hubs) and is written to the shared folder, which cuts lineage. Large-star links each larger
    neighbour to the smallest of the neighbourhood, small-star the smaller ones and the node itself; it ends when a
    whole round changes nothing, after O(log^2 n) rounds.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = common.write(e, "edges")
    before = None
    while True:
        e = spark.read.parquet(path)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(_low(both), both.u == F.col("node")).where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        mid = common.write(large, "large")
        e = spark.read.parquet(mid)
        down = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = _low(down)
        small = (
            down.join(low, down.u == low.node).where("v != low").select(F.col("v").alias("a"), F.col("low").alias("b"))
            .union(low.select(F.col("node").alias("a"), F.col("low").alias("b")))
            .where("a != b").distinct()
        )
        new = common.write(small, "small")
        common.drop(spark, path)
        common.drop(spark, mid)
        path = new
        e = spark.read.parquet(path)
        # the edge set's size and fingerprint: a whole round that leaves both alone has reached the star forest
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    e = spark.read.parquet(path)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
