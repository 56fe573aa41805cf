"""Connected components by star contraction, on DataFrames.

Every round links each node's larger neighbours to its smallest one ("large star"), then its smaller neighbours and
itself ("small star"). Edges become stars around component minima in a number of rounds that grows with the logarithm
of the longest chain. Each round is two aggregations and joins on the node, written to the shared folder; the driver
sees one count per round. A node with very many neighbours is read by the join in parts (skew handling applies: both
sides are exchanged for the join), and its minimum is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a, b with a > b. Links the neighbours of every node to the smallest of them and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        linked = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # edges to smaller neighbours are re-found from the other end, where this node is the larger one
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a > b").distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node on an edge. Any ordered, non-null node type."""
    now = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a > b").distinct()
    now = stored(now, "cc")
    before: tuple[int, int] | None = None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        state = (mark["n"], mark["x"])
        if state == before:
            break
        before = state
        half = stored(_star(now, True), "cc")
        after = stored(_star(half, False), "cc")
        drop_stored(now), drop_stored(half)
        now = after
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
