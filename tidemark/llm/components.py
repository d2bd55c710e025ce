"""Connected components by alternating large-star and small-star steps, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the smallest node reachable.

    Each step reads a table written by the last one, so lineage stays short and lost executors
    cost one step.  The minimum of a node's neighbours is folded in the map tasks.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "edges")
    while True:
        large = star(edges, both=True)
        small = stored(star(large, both=False), "edges")
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        after = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = small
        if before == after:
            break
    heads = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        heads.select("node", F.col("node").alias("label")))


def star(edges: DataFrame, both: bool) -> DataFrame:
    """Link neighbours to the smallest one: larger neighbours only (both), or smaller ones."""
    seen = edges
    if both:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = seen.join(least, "a")
    if both:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
