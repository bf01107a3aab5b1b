"""Connected components of an edge table of any size, by alternating large-star and small-star steps.

State is one edge table. Every step is a minimum per node (combined map-side) joined back to the edges, so a node with
very many neighbours is never collected; the written table cuts lineage and survives lost executors. Rounds run until
the edges stop changing: there is no bound on the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hangs on the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, hang on the smallest of them (edges run from larger to smaller)."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    side = edges.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return side.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that some edge joins to another one.

    Null ends and self loops are ignored, repeated edges count once; nodes without a partner do not appear.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull()).filter("a > b").distinct()
    table, path = written(start, "components")
    before = _state(table)
    while before[0]:
        after_table, after_path = written(_small_star(_large_star(table)), "components")
        after = _state(after_table)
        drop_path(spark, path)
        table, path = after_table, after_path
        if after == before:
            break
        before = after
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        table.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
