"""Connected components by large-star and small-star rounds; the links stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long): the smallest node reachable. Loops and repeats are harmless.

    A round costs two grouped minima and two joins; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = stored(spark, edges)
    state = _state(edges)
    while state[0]:
        # large star: every larger neighbour of a node goes to the least of the node and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small star: the smaller neighbours of a node, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        before, edges = edges, stored(spark, small)
        drop(before)
        if (now := _state(edges)) == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
