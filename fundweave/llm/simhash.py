"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are 64-bit SimHashes over the XXH64 (seed 42) of 3-word shingles. Two fingerprints link
at MAX_BITS or fewer differing bits. Distinct fingerprints only are joined. The trie's root meets
itself; of its pairs of nodes at depth `bits` those within the budget of differing bits are the cells
that are dealt to tasks, so a fingerprint goes to as many cells as there are ways to flip MAX_BITS or
fewer of its first bits. In a cell the walk goes on down a path-compressed trie: of two nodes the one
that branches first is opened, and a pair is dropped as soon as the bits that both have fixed differ
too often. Cells of more than HOT fingerprints are cut into pairs of deeper nodes. A task returns a
spanning forest of the links it finds, never all pairs; pairs of subtrees that are one class already
are not walked. Connected components of all forests give the classes.

Null and empty texts, and texts without words, have fingerprint zero and are linked with each other.
Fewer than three words are one shingle. Repeated rows share a component. component_id is the least
doc_id that is not null; a class of null ids only has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise, ship, table, text_of, words_of
from .components import components
from .near_dup import keep_one  # noqa: F401

MAX_BITS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints of a cell at most before it is cut; depth of the cells at least, and of the cut.
HOT, LEAST_BITS, DEEPER = 2_000_000, 4, 6
#: Node pairs in one step of the walk.
STEP = 400_000


def fingerprint(text: str) -> int:
    w = words_of(text)
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    h = np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the 64-bit values have."""
    n, ones = len(h), np.zeros(64, np.int64)
    for i in range(0, n, 255 * 256):
        bits = np.unpackbits(h[i : i + 255 * 256].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, and fp: the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)
    slim = docs.select(*(F.col(k).alias(f"c{i}") for i, k in enumerate(keep)), text_of().alias("__text"))
    kinds = ", ".join(f"c{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(v.as_py()) for v in b.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fps, pa.int64())], [*b.schema.names[: len(keep)], "fp"])

    return slim.mapInArrow(run, f"{kinds}, fp long").select(*(F.col(f"c{i}").alias(k) for i, k in enumerate(keep)), "fp")


def trie(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Path-compressed binary trie over sorted distinct keys: first key, end, depth of the branch, children of each node.

    The root is node 0. A node's keys agree in the bits before its depth; a leaf (one key) has depth 64.
    """
    lo, hi, depth, left, right = [], [], [], [], []
    a, b, made = np.zeros(min(1, len(keys)), np.int64), np.full(min(1, len(keys)), len(keys)), 0
    while len(a):
        differ = keys[a] ^ keys[b - 1]
        at = _highest(differ)
        inner = np.flatnonzero(differ != 0)
        first = made + len(a) + 2 * np.arange(len(inner))
        l, r = np.full(len(a), -1), np.full(len(a), -1)
        l[inner], r[inner] = first, first + 1
        for kept, x in ((lo, a), (hi, b), (depth, at), (left, l), (right, r)):
            kept.append(x)
        made += len(a)
        # the first key of the right child: the branch's prefix with a one
        bit = np.uint64(1) << (63 - at[inner]).astype(np.uint64)
        split = np.searchsorted(keys, (keys[b[inner] - 1] // bit) * bit)
        a, b = np.stack([a[inner], split], 1).ravel(), np.stack([split, b[inner]], 1).ravel()
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (lo, hi, depth, left, right))


def _highest(x: np.ndarray) -> np.ndarray:
    """Place of the highest set bit, 0 for the top one; 64 for none."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(k)
    return 64 - np.bitwise_count(x).astype(np.int64)


def trie_pairs(keys: np.ndarray, labels: np.ndarray, nodes: tuple[np.ndarray, ...], start: tuple[np.ndarray, np.ndarray], max_bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """labels after joining all pairs of keys within max_bits under the start pairs of nodes, and how many node pairs were visited.

    A pair of nodes is dropped when the bits that both have fixed differ too often, and when all keys of both are one class already.
    """
    lo, hi, depth, left, right = nodes
    stack, steps = [start], 0
    change = None
    while stack:
        u, v = stack.pop()
        if len(u) > STEP:
            half = len(u) // 2
            stack += [(u[half:], v[half:]), (u[:half], v[:half])]
            continue
        steps += len(u)
        fixed = np.minimum(depth[u], depth[v])
        differ = (keys[lo[u]] ^ keys[lo[v]]) >> (64 - np.maximum(fixed, 1)).astype(np.uint64)
        near = (fixed == 0) | (np.bitwise_count(differ) <= max_bits)
        u, v, fixed = u[near], v[near], fixed[near]
        done = fixed == 64
        if done.any():
            i, j = lo[u[done]], lo[v[done]]
            other = labels[i] != labels[j]
            if other.any():
                labels, change = _join_into(labels, i[other], j[other]), None
        u, v = u[~done], v[~done]
        if 4 * len(u) > len(keys):
            if change is None:
                change = np.r_[0, np.cumsum(labels[1:] != labels[:-1])]
            one = (labels[lo[u]] == labels[lo[v]]) & (change[hi[u] - 1] == change[lo[u]]) & (change[hi[v] - 1] == change[lo[v]])
            u, v = u[~one], v[~one]
        own = u == v
        first = depth[u] <= depth[v]  # the node that branches first is opened
        x, y = np.where(first, u, v)[~own], np.where(first, v, u)[~own]
        inner = u[own]
        u = np.concatenate([left[inner], right[inner], left[inner], left[x], right[x]])
        v = np.concatenate([left[inner], right[inner], right[inner], y, y])
        alone = (u == v) & (depth[u] == 64)
        if len(u := u[~alone]):
            stack.append((u, v[~alone]))
    return labels, steps


def _join_into(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels[x]: the least place of x's class so far."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def forest(a: np.ndarray, b: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Spanning links of the rows' cells, and the node pairs visited. A cell: prefixes a <= b of `bits` bits, whose subtrees meet."""
    order = np.lexsort((fp, b, a, bits))
    a, b, bits, fp = (x[order] for x in (a, b, bits, fp))
    edge = np.flatnonzero(np.r_[True, (bits[1:] != bits[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(fp) else np.empty(0, np.int64)
    keys = np.unique(fp)
    labels, steps = np.arange(len(keys)), 0
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(fp)], strict=True):
        at = np.searchsorted(keys, fp[lo:hi])
        nodes = trie(fp[lo:hi])
        local, n = trie_pairs(fp[lo:hi], np.arange(hi - lo), nodes, _roots(nodes, fp[lo:hi], int(a[lo]), int(b[lo]), int(bits[lo])))
        steps += n
        far = np.flatnonzero(local != np.arange(len(local)))
        labels = _join_into(labels, at[far], at[local[far]])
    far = labels != np.arange(len(keys))
    return keys[far], keys[labels[far]], steps


def _roots(nodes: tuple[np.ndarray, ...], keys: np.ndarray, a: int, b: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair of nodes at which a cell's walk begins: its root with itself, or the two subtrees that part at its root."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if a == b:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    own = [int(k) >> (64 - bits) for k in (keys[0], keys[-1])]
    return (nodes[3][:1], nodes[4][:1]) if own == [a, b] else (np.empty(0, np.int64), np.empty(0, np.int64))


def _flips(bits: int, budget: int) -> list[int]:
    return [sum(1 << k for k in c) for n in range(min(budget, bits) + 1) for c in combinations(range(bits), n)]


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")


def _cells(distinct: DataFrame, hot: int, bits: int) -> DataFrame:
    """(bits, a, b, fp): each fingerprint in every pair of nodes at depth `bits`, within the budget of differing bits, to which its own node belongs.

    Pairs of more than `hot` fingerprints are cut into the pairs of nodes DEEPER bits further down that they are made of.
    """
    def meet(rows: DataFrame, depth: int, flip: Column) -> DataFrame:
        own = _prefix(depth)
        return rows.select(F.lit(depth).alias("bits"), F.least(own, own.bitwiseXOR(flip)).alias("a"), F.greatest(own, own.bitwiseXOR(flip)).alias("b"), "fp")

    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    cells = meet(distinct.select("fp", F.explode(longs(_flips(bits, MAX_BITS))).alias("flip")), bits, F.col("flip"))
    done = []
    while not (most := materialise(cells.groupBy("a", "b").count().where(F.col("count") > hot), "hot-cells")).isEmpty() and bits + DEEPER <= 60:
        marked = cells.join(most.select("a", "b", F.lit(True).alias("is_hot")), ["a", "b"], "left")
        done.append(marked.where("is_hot is null").select("bits", "a", "b", "fp"))
        top = F.col("a").bitwiseXOR(F.col("b"))
        low = F.when(top == 0, longs(_flips(DEEPER, MAX_BITS)))
        for used in range(1, MAX_BITS + 1):
            low = low.when(F.bit_count(top) == used, longs(_flips(DEEPER, MAX_BITS - used)))
        cut = marked.where("is_hot").select("fp", F.shiftleft(top, DEEPER).alias("top"), F.explode(low).alias("low"))
        bits += DEEPER
        cells = materialise(meet(cut, bits, F.col("top").bitwiseOR(F.col("low"))), "deeper-cells")
    return reduce(DataFrame.unionByName, [*done, cells])


def links(distinct: DataFrame, hot: int = HOT, bits: int | None = None) -> DataFrame:
    """(fp_a, fp_b, steps): links that span every class of the table of distinct fp; a row of nulls for each task has the node pairs it visited."""
    ship(distinct.sparkSession)
    if bits is None:
        bits = max(LEAST_BITS, int(distinct.count() // hot).bit_length())
    cells = _cells(distinct, hot, bits).repartition("bits", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            t = pa.Table.from_batches(got)
            cell, fp = [t.column(n).to_numpy() for n in ("a", "b", "bits")], t.column("fp").to_numpy().view(np.uint64)
            a, b, steps = forest(*cell, fp)
            none = lambda x: pa.array([*x.view(np.int64).tolist(), None], pa.int64())
            yield pa.RecordBatch.from_arrays([none(a), none(b), pa.array([0] * len(a) + [steps], pa.int64())], ["fp_a", "fp_b", "steps"])

    return cells.mapInArrow(run, "fp_a long, fp_b long, steps long")


def classes(printed: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, root) of every fingerprint in printed; root: the class's least fingerprint as a signed long."""
    distinct = materialise(printed.select("fp").distinct(), "simhash-distinct")
    roots = components(links(distinct, hot).where("fp_a is not null").select("fp_a", "fp_b"))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    printed = materialise(fingerprints(docs, "doc_id"), "simhash")
    least = printed.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes(printed, hot), "fp")
    least = materialise(least, "simhash-least")
    ids = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return printed.join(ids.select("fp", "component_id"), "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
