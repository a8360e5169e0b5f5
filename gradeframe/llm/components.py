"""Connected components by alternating star operations, each a shuffle of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import checkpoint, join_counted


#: Edges that a task should have at least: a small graph isn't dealt out to all partitions again and again.
EDGES = 50_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(rows: DataFrame, total: int) -> DataFrame:
    """rows (a, b) with m, the least of a and its b; a may be a hub."""
    best = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("a", "m"))
    return join_counted(rows, best, "a", "degree", total)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): component is the least node of a connected component.

    Large-star links a node's larger neighbours to the least node around it;
    small-star does so for its smaller ones and itself. Edges only get fewer;
    the number of rounds is about the logarithm of the longest path.
    """
    edges = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    tasks = 2 * size[0] // EDGES + 1
    edges = edges.coalesce(tasks)
    while True:
        large = _least(_both(edges), max(1, 2 * size[0])).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpoint(large.coalesce(tasks).filter("a <> b").distinct().coalesce(tasks))
        small = _least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), max(1, size[0])).coalesce(tasks)
        linked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = checkpoint(linked.filter("a <> b").distinct().coalesce(tasks))
        before, size = size, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(before) == tuple(size):
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
