"""Connected components of a graph held as a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, write_shared


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links of every node's neighbours to the smallest among the node and them.

    The *large* star moves the larger neighbours, the *small* star the smaller ones and the node.
    """
    if small:
        own = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        own = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = own.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    moved = own.join(least, "u")
    if small:
        moved = moved.select(F.col("v").alias("a"), F.col("least").alias("b")).union(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
    else:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    return moved.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of all nodes in ``links`` (a, b).

    Large and small stars alternate until nothing changes; every round is written to the shared
    folder. Links to oneself and repeated links do no harm, null ends are ignored, and an empty table
    gives no rows. A node without links has no row.
    """
    spark = links.sparkSession
    edges, path = write_shared(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        changed, next_path = write_shared(_star(_star(edges, False), True), "links")
        count = changed.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_shared(spark, path)
        edges, path = changed, next_path
        if tuple(count) == mark:
            break
        mark = tuple(count)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
