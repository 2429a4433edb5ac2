"""Connected components of a graph by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Each step sends a neighbour's smallest neighbour along the edges and writes its result to the shared folder, so a
    lost executor repeats one step at most. The edges end as stars around each smallest node. Rows with a null end and
    loops carry no link. An empty graph has no rows.
    """
    e = (
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = table(e, "edges")
    if not e.take(1):
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        # stars already: every node has one smaller neighbour, which has none
        if not (e.groupBy("a").count().filter("count > 1").take(1) or e.join(e.select(F.col("a").alias("b")), "b", "left_semi").take(1)):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        # large star: each larger neighbour of a node moves to the node's smallest neighbour, itself included
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = table(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        drop(e, least)
        # small star: each smaller neighbour of a node, and the node, move to the smallest of them
        least = table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = table(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        drop(large, least)
