"""Near-duplicates of the pipeline: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are linked.

SimHash proposes first: fingerprints of the five-word shingles are joined by simhash's trie, and the pairs of
its forest that are similar enough are links. At 0.8 fingerprints differ in up to 11 bits, more than the trie's
walk can join, so what lies beyond its MAX_BITS is left to MinHash: BANDS keys of ROWS minima each, so a pair at
0.8 shares no key in one case of 20,000. The exact similarity decides on all. Documents of one shingle set are one node. The nodes of a key are a
bucket; a bucket whose nodes are in one class already is done. In REPRESENTED rounds a bucket's least
and greatest node are compared with all others of other classes and then leave it, so that a large group
of near copies takes a few comparisons a node. What is still open then is compared in blocks: a bucket's
nodes are dealt to blocks of about WIDE, each pair of blocks meets in one task, and the task gives the
links that join classes, never the pairs. So every proposed pair is compared or linked through others.

Texts of fewer than five words are one shingle. Null and empty texts and texts without words are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import drop, materialise, ship, text_of, words_of
from .components import components
from .encoding import release

SHINGLE, LEAST, BANDS, ROWS, SEED = 5, 0.8, 25, 5, 42
REPRESENTED, WIDE, CHUNK = 2, 256, 4096
_ODD, _MASK = (np.random.default_rng(SEED).integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_ODD, _MASK = _ODD | np.uint64(1), _MASK * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    w = words_of(text)
    if not w:
        return np.empty(0, "<u8")
    parts = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    return np.unique(np.array([xxh64_intdigest(s, SEED) for s in parts], dtype="<u8"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def keys_of(h: np.ndarray) -> np.ndarray:
    """A key for each band; none without shingles."""
    if not len(h):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), CHUNK):
        least = np.minimum(least, ((h[i : i + CHUNK][None, :] ^ _MASK) * _ODD).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def nodes(keyed: DataFrame) -> DataFrame:
    """doc_id, __h, node (hash of the shingle set), keys and fp (SimHash, as a signed long) of every row."""
    from .simhash import majority  # which imports keep_one from here

    ship(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            ids, keys, fps = [], [], []
            for v in b.column(2):
                h = shingles(v.as_py())
                ids.append(xxh64_intdigest(h.tobytes(), SEED))
                keys.append(keys_of(h))
                fps.append(majority(h))
            flat = np.concatenate([*keys, np.empty(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, fps)), lists], ["doc_id", "__h", "node", "fp", "keys"])

    return keyed.select("doc_id", "__h", text_of().alias("__text")).mapInArrow(run, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, __h long, node long, fp long, keys array<long>")


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, h): the shingle set of each node."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array([shingles(x.as_py() or "").tobytes() for x in t.column(1)], pa.binary())], ["node", "h"])

    return texts.select("node", "text").mapInArrow(run, "node long, h binary")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough."""
    b = pairs.join(sets.select(F.col("node").alias("b"), F.col("h").alias("h_b")), "b")
    both = b.join(sets.select(F.col("node").alias("a"), F.col("h").alias("h_a")), "a").select("a", "b", "h_a", "h_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            hit = [jaccard(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) >= LEAST for x, y in zip(t.column(2), t.column(3), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def block_links(node: list[int], root: list[int], block: list[int], h: list[bytes]) -> list[tuple[int, int]]:
    """Links that join the classes of one pair of blocks: nodes of different blocks, or of one block where there is only one."""
    sizes = np.array([len(x) // 8 for x in h])
    _, shingle = np.unique(np.frombuffer(b"".join(h), "<u8"), return_inverse=True)
    label, block, first = np.unique(np.array(root), return_inverse=True)[1], np.array(block), np.cumsum(sizes) - sizes
    alone, filled, out = len(set(block.tolist())) == 1, sizes > 0, []
    mark = np.zeros(len(shingle) + 1, bool)
    for k in np.flatnonzero(filled).tolist():
        other = filled & (label != label[k]) & (alone | (block != block[k]))
        other[:k] = False
        if not other.any():
            continue
        own = shingle[first[k] : first[k] + sizes[k]]
        mark[own] = True
        both = np.add.reduceat(mark[shingle], first[filled], dtype=np.int64)
        mark[own] = False
        shared = np.zeros(len(sizes), np.int64)
        shared[filled] = both
        for j in np.flatnonzero(other & (shared >= LEAST * (sizes + sizes[k] - shared))).tolist():
            if label[j] != label[k]:
                label[label == label[j]] = label[k]
                out.append((node[k], node[j]))
    return out


def in_blocks(live: DataFrame, sets: DataFrame, wide: int = WIDE) -> DataFrame:
    """(a, b): links between classes of each bucket's nodes. live: node, root, key, n (nodes of the bucket)."""
    blocks = F.ceil(F.col("n") / wide).cast("int")
    dealt = live.withColumn("g", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("g")).cast("int"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "node", "root", "block")
    met = met.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])

        def close():
            got = block_links(*held) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        for t in batches:
            for key, i, j, *row in zip(*(t.column(n).to_pylist() for n in ("key", "i", "j", "node", "root", "block", "h")), strict=True):
                if (key, i, j) != now and now is not None:
                    yield close()
                    held = [], [], [], []
                now = key, i, j
                for kept, x in zip(held, row, strict=True):
                    kept.append(x)
        if now is not None:
            yield close()

    return met.mapInArrow(run, "a long, b long")


def proposed(rows: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints simhash's trie links: each with the least node of its fingerprint, and the least nodes of linked fingerprints. rows: node, fp, keys."""
    from .simhash import links

    filled = rows.where("size(keys) > 0").select("node", "fp")
    least = materialise(filled.groupBy("fp").agg(F.min("node").alias("least")), "near-prints")
    same = filled.join(least, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = links(least.select("fp")).where("fp_a IS NOT NULL").select("fp_a", "fp_b")
    for end in ("a", "b"):
        near = near.join(least.select(F.col("fp").alias(f"fp_{end}"), F.col("least").alias(end)), f"fp_{end}")
    got = materialise(same.unionByName(near.select("a", "b")), "near-proposed")
    drop(least)
    return got


def classes(printed: DataFrame, keyed: DataFrame, wide: int = WIDE) -> DataFrame:
    """(node, root) of the nodes that are linked to another one. printed: nodes(keyed)."""
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__h")
    rows = printed.groupBy("node").agg(F.min(rank).alias("r"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    rows = materialise(rows, "near-nodes")
    cells = rows.select("node", F.explode("keys").alias("key"))
    shared = cells.groupBy("key").count().where("count > 1").select("key")
    members = materialise(cells.join(shared, "key"), "near-members")
    offered = proposed(rows)
    met = members.select("node").unionByName(offered.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    want = rows.join(met, "node").select("node", F.col("r.doc_id").alias("k_id"), F.col("r.__h").alias("k_h"))
    texts = keyed.join(want, keyed["doc_id"].eqNullSafe(want["k_id"]) & (keyed["__h"] == want["k_h"])).select("node", "text")
    sets = materialise(sets_of(texts.dropDuplicates(["node"])), "near-sets")
    links, at = materialise(similar(offered, sets), "near-links"), 0
    roots = materialise(components(links).distinct(), "near-roots")
    drop(offered)
    while True:
        seen = members.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "key", F.coalesce("root", "node").alias("root"))
        open_ = seen.groupBy("key").agg(F.min(F.struct("node", "root")).alias("lo"), F.max(F.struct("node", "root")).alias("hi"), F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("open")).where("open")
        live = materialise(seen.join(open_.drop("open"), "key"), "near-live")
        if live.isEmpty():
            break
        if at < REPRESENTED:
            ends = live.select("node", "root", F.explode(F.array("lo", "hi")).alias("p")).where("root != p.root").select("node", F.col("p.node").alias("p"))
            found = similar(ends.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), sets)
        else:
            found = in_blocks(live, sets, wide)
        old, links = links, materialise(links.unionByName(found), "near-links")
        drop(members, old)
        members = live.where((F.col("node") != F.col("lo.node")) & (F.col("node") != F.col("hi.node"))).select("node", "key")
        roots = materialise(components(links).distinct(), "near-roots")
        if at == REPRESENTED:
            break
        at += 1
    drop(rows, sets)
    return roots


def keep_one(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """Rows of docs, one for each class: that with the least doc_id (null last), then least text hash. Of repeated rows one stays, that with the least other columns as JSON."""
    names = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)]
    keyed = docs.toDF(*names).withColumn("__h", F.xxhash64("text"))
    printed = materialise(nodes(keyed), "near")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__h")
    best = printed.groupBy("node").agg(F.min(rank).alias("best"))
    roots = classes(printed, keyed, wide).withColumnRenamed("node", "r_node")
    best = best.join(roots, best["node"] == roots["r_node"], "left").groupBy(F.coalesce("root", "node")).agg(F.min("best").alias("best"))
    best = materialise(best.select(F.col("best.doc_id").alias("k_id"), F.col("best.__h").alias("k_h")), "near-kept")
    kept = keyed.join(best, keyed["doc_id"].eqNullSafe(best["k_id"]) & (keyed["__h"] == best["k_h"]), "left_semi")
    repeats = printed.groupBy("doc_id", "__h").count().where("count > 1").limit(1).count()
    drop(printed)
    if repeats:  # of rows alike in doc_id and text that with the least other columns
        whole = F.to_json(F.struct(*names))
        kept = kept.groupBy("doc_id", "__h").agg(F.min_by(F.struct(*names), whole).alias("r")).select("r.*")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
