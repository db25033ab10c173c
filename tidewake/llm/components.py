"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import small, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, component)`` for each node of ``edges``; component: its smallest node.

    Edges are undirected pairs of integers; loops, repeats and rows with nulls
    count for nothing; no edges give no rows. Every round replaces the edges by
    as many at most and is written to the shared folder. Minima come from
    pre-aggregated groups, and a round's join has a written table on either
    side, so that a hub (a node of very many edges) is broadcast against or
    split by adaptive execution and never gathered in one task.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = pairs.where("u <> v")  # nulls go as well
    now = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        count, check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if count == 0 or (count, check) == before:
            break
        before = (count, check)
        now = written(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def smallest_of_components(edges: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(node, smallest)``: the smallest ``first`` in the node's component, for each node of ``edges``.

    ``firsts`` has a row ``(node, first)`` for every node.
    """
    comp = written(connected_components(edges))
    named = written(comp.join(firsts, "node").groupBy("component").agg(F.min("first").alias("smallest")))
    return written(comp.join(small(named), "component").select("node", "smallest"))


def _large_star(down: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours.

    ``down``: edges from the larger (u) to the smaller end (v).
    """
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return written(
        both.where("v > u").join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(down: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    least = written(down.groupBy("u").agg(F.min("v").alias("m")))
    rest = down.join(small(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
