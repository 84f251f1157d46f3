"""Connected components of a graph of links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import kept, measured_ids


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node reachable.

    Stars are contracted in turn: the larger neighbours of each node, then the smaller ones, move to its
    smallest neighbour, until nothing moves; the number of rounds grows with the logarithm of the longest
    chain. A hub's links are combined before the shuffle; the smallest neighbours are written and then joined,
    by broadcast if their measured size allows, else by a join that no aggregate shares a stage with, so that
    Spark can split a hub. Null ends and self-links drop out, repeated links count once.
    """
    edges = kept(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while True:
        if edges.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # Larger neighbours of every node go to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = kept(both.where("b > a").join(measured_ids(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Smaller neighbours, and the node itself, go to the smallest.
        least = kept(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        moved = large.join(measured_ids(kept(least.where("n > 1").select("a", "m"))), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = kept(least.select("a", F.col("m").alias("b")).unionByName(moved).distinct())
        # Done when every node has one link, and no link ends where another begins.
        if moved.isEmpty() and after.select("a").intersect(after.select("b")).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = after
