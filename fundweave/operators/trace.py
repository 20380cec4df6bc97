"""Reachability, shortest paths and cycles over raw accounts of confirmed rows.

Loops run one join a hop. Each hop's frontier is written to the shared folder, so plans stay short
and a lost executor costs one hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise

MAX_HOPS, MAX_CYCLES = 8, 50


def account_edges(tx: DataFrame, backwards: bool = False) -> DataFrame:
    a, b = ("payee_account", "payer_account") if backwards else ("payer_account", "payee_account")
    return tx.where("review_status = 'confirmed'").select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


def _one(spark: SparkSession, node: str) -> DataFrame:
    return spark.createDataFrame([(node, 0)], "node string, depth int")


def reach(edges: DataFrame, start: str, hops: int, clamp: bool = True) -> DataFrame:
    """(node, depth) within so many hops of start, start included; hops is held to 0..8."""
    spark = edges.sparkSession
    edges = materialise(edges, "trace-edges")
    seen = frontier = _one(spark, start)
    for depth in range(1, (max(0, min(hops, MAX_HOPS)) if clamp else hops) + 1):
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).where("node is not null").distinct()
        frontier = materialise(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "trace-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """One row, path: the least path in array order among the shortest, or an empty array."""
    spark = edges.sparkSession
    edges = materialise(edges, "trace-edges")
    seen = frontier = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    while True:  # ends when the frontier has no new node
        hit = frontier.where(F.col("node") == end)
        if not hit.isEmpty():
            return hit.select("path")
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        found = found.where("node is not null").groupBy("node").agg(F.min("path").alias("path"))
        frontier = materialise(found.join(seen.select("node"), "node", "left_anti"), "trace-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return spark.createDataFrame([([],)], "path array<string>")


def cycles(edges: DataFrame, start: str, hops: int, most: int = MAX_CYCLES, width: int = 4096) -> DataFrame:
    """Simple cycles through start of at most hops + 2 edges, self-loops left out: the first `most` in array order.

    Only nodes from which start can be reached in what is left of the edges stay in a path. Each length
    keeps its `width` least paths; everything that grows from a path dropped is greater than it, so the
    answer holds if `most` cycles are less than the least path dropped. Else the search runs anew, eight
    times as wide.
    """
    longest = hops + 2
    edges = materialise(edges, "trace-edges")
    back = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, longest - 1, clamp=False)
    back = materialise(back.withColumnRenamed("depth", "to_start"), "trace-back")
    closing = materialise(edges.join(back, edges["dst"] == back["node"]).select("src", "dst", "to_start"), "trace-edges")
    while True:
        found, dropped = _least_cycles(closing, start, longest, most, width)
        sure = found if dropped is None else [p for p in found if p < dropped]
        if dropped is None or len(sure) == most:
            return edges.sparkSession.createDataFrame([(p,) for p in sure], "path array<string>")
        width *= 8


def _least_cycles(edges: DataFrame, start: str, longest: int, most: int, width: int) -> tuple[list, list | None]:
    """The least `most` cycles that the `width` least paths of each length give, and the least path that was dropped."""
    paths = edges.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>")
    found, dropped = [], None
    for n in range(1, longest + 1):
        step = paths.join(edges, paths["node"] == edges["src"])
        path = F.concat("path", F.array("dst")).alias("path")
        if n > 1:
            found += [list(r.path) for r in step.where(F.col("dst") == start).select(path).orderBy("path").limit(most).collect()]
        grown = step.where(~F.array_contains("path", F.col("dst")) & (F.col("to_start") + n <= longest)).select(F.col("dst").alias("node"), path)
        grown = materialise(grown.orderBy("path").limit(width + 1), "trace-paths")
        paths = grown.orderBy("path").limit(width)
        if over := grown.orderBy("path").offset(width).limit(1).collect():
            dropped = min(dropped or list(over[0].path), list(over[0].path))
        if grown.isEmpty():
            break
    return sorted(found)[:most], dropped


def bundle(tx: DataFrame, start: str, end: str, hops: int) -> DataFrame:
    """One row with all of the above, lists sorted. A report on one account: the lists are bounded by what its hops reach."""
    forward = materialise(account_edges(tx), "trace-edges")
    backward = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    listed = lambda d, c: d.agg(F.array_sort(F.collect_list(c))).scalar()
    one = tx.sparkSession.createDataFrame([(start, end, hops)], "start string, end string, hops int")
    return one.withColumns({
        "upstream": listed(reach(backward, start, hops), "node"), "downstream": listed(reach(forward, start, hops), "node"),
        "shortest_path": shortest_path(forward, start, end).scalar() if end else F.array().cast("array<string>"), "cycles": listed(cycles(forward, start, hops), "path"),
    })


def bundle_rows(tx: DataFrame, start: str, end: str, hops: int) -> DataFrame:
    """(kind, item, depth): the same as rows: upstream and downstream nodes with their depth, the shortest path and the cycles as lists. However much the hops reach, no row grows with it."""
    forward = materialise(account_edges(tx), "trace-edges")
    backward = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = lambda kind, edges: reach(edges, start, hops).select(F.lit(kind).alias("kind"), F.array("node").alias("item"), F.col("depth").cast("int").alias("depth"))
    paths = lambda kind, found: found.select(F.lit(kind).alias("kind"), F.col("path").alias("item"), F.lit(None).cast("int").alias("depth"))
    got = nodes("upstream", backward).unionByName(nodes("downstream", forward)).unionByName(paths("cycle", cycles(forward, start, hops)))
    return got.unionByName(paths("shortest_path", shortest_path(forward, start, end))) if end else got
