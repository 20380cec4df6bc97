"""Connected components of an undirected graph given as an edge table: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (u, v). Each node's neighbours are handed to the least node that it knows."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")  # a hub's rows are split by AQE's skew join
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable. edges: two columns of one orderable type."""
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    edges, before = materialise(edges, "edges"), None
    for _ in range(rounds):
        edges = materialise(_star(_star(edges, False), True), "edges")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        if state == before and state[0] == state[2]:
            break
        before = state
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
