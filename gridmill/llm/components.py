"""Connected components by alternating large-star and small-star, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node sends its larger neighbours to its smallest one.

    The smallest ones are written first, so that the join has two plain shuffles, and Spark can split a node with many edges.
    """
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of these. The edges have a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to one row (node, component) for each node that has an edge, component being its smallest node.

    Loops and null ends are ignored; repeated edges count once; no edges give no rows. Each round is written to the
    shared folder, so lost executors cost one round at most.
    """
    a, b = F.col("a"), F.col("b")
    e = cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = None
    while True:
        large, least = _large_star(e)
        new = cut(_small_star(large), "edges")
        drop(e, least)
        e, (was, mark) = new, (mark, new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())
        if mark == was:
            break
    return e.select(a.alias("node"), b.alias("component")).unionByName(e.select(b.alias("node"), b.alias("component")).distinct())
