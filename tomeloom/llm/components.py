"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> node, root: each node that has an edge, and the least node of its component.

    First every node hands its other smaller neighbours to the least one until each has a single
    smaller neighbour (a forest); then the pointers are doubled until they end at roots. Nothing
    is collected; each round is written to the checkpoint folder.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        sums = e.groupBy("b").agg(F.count("*").alias("n")).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges")).first()
        if sums["nodes"] == sums["edges"]:
            break
        least = e.groupBy("b").agg(F.min("a").alias("m"))
        met = e.join(least, "b")
        handed = met.where("a <> m").select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b"))
        e = cut(handed.unionByName(least.select(F.col("m").alias("a"), "b")).distinct())
    tree = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = cut(tree.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        tree = moved.select("node", "root")
        if moved.where("moved").limit(1).count() == 0:
            break
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
