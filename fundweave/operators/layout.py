"""Layered layout and focus states of the graph."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, materialise
from .running import places


#: Edges of a block, which one task walks to its end.
BLOCK = 100_000


def _blocks(edges: DataFrame) -> DataFrame:
    """(source, target, block): the edges in the order of their ends, BLOCK to a block. A node of many edges lies in several blocks."""
    ends = edges.select("source", "target").where("source != target").distinct()
    placed = places(ends, [F.asc("source"), F.asc("target")], "layout-ends")
    return materialise(placed.select("source", "target", F.floor((F.col("place") - 1) / BLOCK).alias("block")), "layout-blocks")


def _walk(step: int):
    def run(edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """The lesser values that the fresh ones of known (node, value, fresh) give to nodes along one block's edges."""
        below, best, told = {}, dict(zip(known["node"], known["value"], strict=True)), {}
        for source, target in zip(edges["source"], edges["target"], strict=True):
            below.setdefault(source, []).append(target)
        heap = [(v, n) for n, v, fresh in zip(known["node"], known["value"], known["fresh"], strict=True) if fresh]
        heapify(heap)
        while heap:
            value, node = heappop(heap)
            if best[node] < value:
                continue
            value = value + step if step else value
            for n in below.get(node, ()):
                if n not in best or value < best[n]:
                    best[n] = told[n] = value
                    heappush(heap, (value, n))
        return pd.DataFrame({"node": list(told), "value": list(told.values())}, dtype=object)

    return run


def settled(blocks: DataFrame, start: DataFrame, step: int) -> DataFrame:
    """(node, value): the least value that reaches each node from start (node, value), `step` more along each edge.

    In a round every block that has fresh values is walked to its end by one task, so the rounds are as many as the times
    that a path changes blocks, not as its edges. blocks: _blocks().
    """
    homes = materialise(blocks.select(F.col("source").alias("node"), "block").distinct(), "layout-homes")
    kind = start.schema["value"].dataType.simpleString()
    state, fresh = start, start
    while True:
        flag = fresh.select("node", F.lit(True).alias("fresh"))
        live = materialise(homes.join(flag, "node").select("block").distinct(), "layout-live")
        known = homes.join(live, "block").join(state, "node").join(flag, "node", "left").select("block", "node", "value", F.coalesce("fresh", F.lit(False)).alias("fresh"))
        told = blocks.join(live, "block").groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_walk(step), f"node string, value {kind}")
        told = told.groupBy("node").agg(F.min("value").alias("told"))
        new = told.join(state, "node", "left").where("value IS NULL OR told < value").select("node", F.col("told").alias("value"))
        new = materialise(new, "layout-fresh")
        if fresh is not start:
            drop(fresh)
        drop(live)
        if new.isEmpty():
            drop(new, homes)
            return state
        old, fresh = state, new
        both = state.withColumnRenamed("value", "was").join(new, "node", "full")
        state = materialise(both.select("node", F.coalesce("value", "was").alias("value")), "layout-state")
        if old is not start:
            drop(old)


def least_ancestors(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the least node from which each of nodes (node) can be reached, itself included.

    Taking nodes by id, each that none before it reaches starts a layout anew. So it is a root exactly if it is its own
    least ancestor, and what it reaches first is what has it as the least. All roots are found at once. blocks: _blocks().
    """
    return settled(blocks, nodes.select("node", F.col("node").alias("value")), 0).withColumnRenamed("value", "root")


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth): nodes without incoming edges are at 0; then, by id, what they do not reach starts anew at 0. The jobs do not grow with the number of cycles."""
    ids = materialise(edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct(), "layout-nodes")
    first = materialise(ids.join(edges.select(F.col("target").alias("node")), "node", "left_anti").withColumn("value", F.lit(0)), "layout-first")
    seen = first
    if not first.isEmpty():
        blocks = _blocks(edges)
        seen = settled(blocks, first, 1)
        drop(blocks)
    rest = materialise(ids.join(seen, "node", "left_anti"), "layout-rest")
    drop(ids)
    if rest.isEmpty():
        return seen.withColumnRenamed("value", "depth")
    inner = edges.select("source", "target").join(rest.withColumnRenamed("node", "source"), "source").join(rest.withColumnRenamed("node", "target"), "target")
    inner = _blocks(inner)
    rooted = materialise(least_ancestors(inner, rest), "layout-rooted")
    # below a root only what it is the least ancestor of; all roots start together
    own = inner.join(rooted.select(F.col("node").alias("source"), F.col("root").alias("r0")), "source").join(rooted.select(F.col("node").alias("target"), F.col("root").alias("r1")), "target").where("r0 = r1")
    own = materialise(own.select("source", "target", "block"), "layout-own")
    start = materialise(rooted.where("node = root").select("node", F.lit(0).alias("value")), "layout-start")
    found = settled(own, start, 1)
    both = materialise(seen.unionByName(found).withColumnRenamed("value", "depth"), "layout-depths")
    drop(first, seen, found, start, rest, inner, rooted, own)
    return both


def path_ranks(rows: DataFrame) -> DataFrame:
    """rows (node, parent, depth) with rank: in a layer it orders nodes as their paths from the root order, id by id.

    Pointer doubling: the rank of a path of 2k nodes comes from that of its upper and its lower half, so it
    takes the logarithm of the depth in rounds, each one range sort of all layers together.
    """
    by_id = places(rows.select("node", F.col("parent").alias("up"), "depth"), [F.asc("node")], "layout-ranks").withColumnRenamed("place", "rank")
    state, deepest = materialise(by_id, "layout-ranks"), rows.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):
        above = state.select(F.col("node").alias("up"), F.col("rank").alias("upper"), F.col("up").alias("next"))
        met = state.join(above, "up", "left").select("node", "depth", F.col("next").alias("up"), "upper", "rank")
        ranked = places(met, [F.asc_nulls_first("upper"), F.asc("rank")], "layout-ranks")
        old, state = state, materialise(ranked.select("node", "up", "depth", F.col("place").alias("rank")), "layout-ranks")
        drop(old)
    return state.select("node", "depth", "rank")


def layered(edges: DataFrame) -> DataFrame:
    """(node, depth, primary_edge, x, y). Nodes of a layer stand by their parent's place, then id."""
    d = materialise(depths(edges), "layout-depths")
    up = edges.join(d.select(F.col("node").alias("source"), F.col("depth").alias("d0")), "source").join(d.select(F.col("node").alias("target"), F.col("depth").alias("d1")), "target")
    best = up.where("d0 = d1 - 1").groupBy(F.col("target").alias("node")).agg(F.min_by(F.struct("id", "source"), F.struct("first_transaction_time", -F.col("amount"), "id")).alias("p"))
    rows = materialise(d.join(best, "node", "left").select("node", "depth", F.col("p.id").alias("primary_edge"), F.col("p.source").alias("parent")), "layout-rows")
    placed = places(path_ranks(rows), [F.asc("depth"), F.asc("rank")], "layout-places")
    layers = materialise(placed.groupBy("depth").agg(F.min("place").alias("first"), F.count("*").alias("n")), "layout-layers")
    most = layers.select(F.max("n")).scalar()
    out = placed.join(layers, "depth").join(rows.select("node", "primary_edge"), "node")
    y = 60 + (most - F.col("n")) * 20 + 40 * (F.col("place") - F.col("first"))
    return out.select("node", "depth", "primary_edge", (80 + 260 * F.col("depth")).alias("x"), y.cast("double").alias("y"))


def focus(edges: DataFrame, selected: str) -> DataFrame:
    """(node, state) for a selected node: of a node that is both, the later edge, in the order of first sight, decides."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), (F.col("target") == selected).alias("near"), F.lit("incoming-neighbor").alias("state")), F.struct(F.col("target").alias("node"), (F.col("source") == selected).alias("near"), F.lit("outgoing-neighbor").alias("state")))).alias("e"), "first_seq")
    last = ends.groupBy("e.node").agg(F.max_by("e.state", F.when(F.col("e.near"), F.col("first_seq"))).alias("s"))
    return last.select("node", F.when(F.col("node") == selected, "selected").otherwise(F.coalesce("s", F.lit("inactive"))).alias("state"))


def focus_states(edges: DataFrame, node: str = "", edge: str = "", playing: str = "") -> DataFrame:
    """(kind, id, state) of nodes and edges. A playing edge decides before a selected edge, that before a selected node; with none, states are null."""
    one = playing or edge
    own = F.col("id") == one if one else F.lit(False)
    if one:
        names = ("playing", "playing-source", "playing-target") if playing else ("selected", "edge-endpoint", "edge-endpoint")
        mine, near, far = (F.when(own, x) for x in names)
    else:
        mine = F.when(F.col("target") == node, "incoming").when(F.col("source") == node, "outgoing")
        near = far = F.lit(None).cast("string")
    row = lambda kind, c, state, n: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id"), state.alias("state"), F.lit(n).alias("n"))
    rows = edges.select(F.explode(F.array(row("node", "source", near, 0), row("node", "target", far, 1), row("edge", "id", mine, 0))).alias("r")).select("r.*")
    states = rows.groupBy("kind", "id").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("n"))).alias("state"))
    if one:
        return states.fillna("inactive", "state")
    if not node:
        return states
    return states.where("kind = 'edge'").fillna("inactive", "state").unionByName(focus(edges, node).select(F.lit("node").alias("kind"), F.col("node").alias("id"), "state"))
