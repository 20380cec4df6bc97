"""Self-join of documents by the Jaccard similarity of their sets of word n-grams: prefix filters under several global orders.

Sets of SHINGLE-word shingles link at a similarity of LEAST percent or more. A set of n shingles shares ceil(LEAST n / 100) of them at
least with any partner, so under *any* order of all shingles the first n - ceil(LEAST n / 100) + k of
both hold k common ones. Four orders are used, and a pair must pass all before it is verified:

- plain order of hashes, with k growing with n: sets of which fewer prefix shingles are prefix
  shingles elsewhere go. Chance and shared passages don't reach that number, so most sets go.
- three more orders, in which shingles that only one of the sets left holds come first and those that many hold last, the
  commonest at the very end, and which else follow three different hashes; k is 1. A lone shingle is shared with nobody, so it
  takes a place of the prefix and is left out; a set with a prefix of lone shingles only goes, and two sets share at most
  what either has besides. Under the first of these orders, sets that share a prefix shingle form a
  bucket (shingles with the same sets are one bucket); of a bucket's pairs those that share one under the
  second and the third are candidates. Their exact overlap decides.

Prefix shingles are cut to 48 bits, which can only add candidates. What is left after the first order
is shuffled as compressed words, a third of the size of their shingles' hashes.

Sets that are equal are one node, and links are only sought between classes. First each node is compared with the node it
shares most buckets with, among the buckets' least ones. Buckets that hold several classes then are
compared in groups, a family of buckets with many nodes in common as one group or each bucket itself, cut by size (partners'
sizes lie within LEAST percent), whichever is less. A group's nodes are dealt to blocks of a bounded size, each
pair of blocks meets in one task, and the task gives links that join classes, never the pairs. So
every candidate is compared or linked through others.

Which shingles come last only decides how much work is left, as every fixed order is right; so
their table may be bounded (MOST_LAST), and is broadcast. Lone shingles stand with their set.

Fewer than SHINGLE words are one shingle. Null and empty texts, and texts without words, have no shingles and link with
nothing, so each is a class of its own. Repeated rows share a class. component_id is the least doc_id that is not null; a class of null ids only has none.
Shingles are known by 64-bit hashes. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import drop, materialise, ship, table, text_of, words_of
from .components import components

SHINGLE, LEAST, SEED = 4, 85, 42
#: A shingle comes late from so many sets on that hold it; entries of that table at most.
LATE, MOST_LAST = 32, 500_000
#: Bits of the table of wanted texts, 4 MB.
BITS = 2**25
#: Of the plain order's prefix, one more for each MORE shingles of a set.
MORE = 30
#: Nodes and shingles of a block, about; partners of one representative in a task.
WIDE, HEAVY, STAR = 256, 500_000, 1024
#: Sizes of partners lie in one class or in two that adjoin; wider than needed, for rounding.
SIZE_CLASS = -log(LEAST / 100 - 0.01)
_ODD, _MASK = (np.random.default_rng(SEED).integers(0, 2**64, 8, dtype=np.uint64) for _ in range(2))
_ODD |= np.uint64(1)
ORDERS, CUT = 3, np.uint64(16)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A one-to-one function of 64-bit values."""
    h = (h ^ _MASK[k]) * _ODD[k]
    h ^= h >> np.uint64(31)
    return h * _ODD[k]


def shingles_of(words: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    wide = min(SHINGLE, len(w))
    h = np.zeros(len(w) - wide + 1, np.uint64)
    for k in range(wide):
        h = _mixed(h + w[k : len(w) - wide + 1 + k], 7)
    return np.unique(_mixed(h ^ np.uint64(wide), 6))


def shingles(text: str) -> np.ndarray:
    return shingles_of(words_of(text))


def prefix_size(n: int) -> int:
    return n + LEAST * n // -100 + 1


def wide_prefix_size(n: int) -> int:
    """Of the plain order's prefix: any partner shares shared_at_least(n) of it, in its own."""
    return min(n, prefix_size(n) + n // MORE)


def shared_at_least(size: Column) -> Column:
    """1 and as many more as the least partner's prefix has."""
    return 1 + F.floor(F.floor((LEAST * size + 99) / 100) / MORE)


class Late:
    """The shingles that come late, and how late; known by their values under the plain order."""

    def __init__(self, value: np.ndarray, level: np.ndarray):
        order = np.argsort(value)
        self.value, self.level = value[order], level[order]

    def of(self, h: np.ndarray) -> np.ndarray | None:
        if not len(self.value):
            return None
        value = _mixed(h, 0) >> CUT
        at = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
        found = self.value[at] == value
        return np.where(found, self.level[at], 0) if found.any() else None


def prefix(h: np.ndarray, order: int, late: Late | None = None, size: int | None = None) -> np.ndarray:
    """The prefix under an order, as values that stand for the shingles there."""
    value, size = _mixed(h, order), size or prefix_size(len(h))
    level = late.of(h) if late else None
    if level is not None:
        return value[np.lexsort((value, level))[:size]] >> CUT
    return (np.partition(value, size - 1)[:size] if size < len(value) else value) >> CUT


def linked(a: int, b: int, both: int) -> bool:
    return 100 * both >= LEAST * (a + b - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def _longs(lists: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*lists, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(flat))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, size, node (hash of the set) and the prefix under the plain order, of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(2)]
            node = np.array([xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            first = _longs([prefix(h, 0, size=wide_prefix_size(len(h))) if len(h) else h for h in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(h) for h in sets], pa.int64()), pa.array(node), first], ["doc_id", "text_hash", "size", "node", "first"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_of().alias("__text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, size long, node long, first array<long>")


def marks(want: DataFrame) -> np.ndarray:
    """BITS bits, as bytes: those of the text hashes k_hash are set. In 32,768 bits a row through the driver."""
    bit = F.pmod("k_hash", F.lit(BITS)) + 1
    rows = want.groupBy(F.bitmap_bucket_number(bit).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    for n, bits in zip(rows.column("n").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[(n - 1) * len(bits) : n * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def packed(docs: DataFrame, want: DataFrame) -> DataFrame:
    """(id, size, z): the words of the texts of want (id, size, k_id, k_hash), compressed before they are shuffled.

    Most texts are not wanted: the bits of marks() leave few of them, and the join decides.
    """
    ship(docs.sparkSession)
    bits = docs.sparkSession.sparkContext.broadcast(marks(want))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for t in batches:
            at = t.column(1).to_numpy() % BITS
            t = t.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            z = [press.compress(b" ".join(words_of(x.as_py()))) for x in t.column(2)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(z, pa.binary())], ["doc_id", "text_hash", "z"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_of().alias("__text"))
    some = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, z binary")
    return some.join(want, some["doc_id"].eqNullSafe(want["k_id"]) & (some["text_hash"] == want["k_hash"])).select("id", "size", "z")


def unpacked(z: bytes) -> np.ndarray:
    return shingles_of(zstandard.decompress(z).split(b" "))


def held_by(sets: DataFrame) -> DataFrame:
    """(value, n, id): the shingles, under the plain order, that one set alone holds (id) or LATE sets or more (id is one of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            lists = [_mixed(unpacked(x.as_py()), 0) >> CUT for x in t.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t.column(0).to_numpy(), [len(x) for x in lists])), _longs(lists).values], ["id", "value"])

    cells = sets.select("id", "z").mapInArrow(run, "id long, value long")
    return cells.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("id")).where((F.col("n") == 1) | (F.col("n") >= LATE))


def with_lone(sets: DataFrame, held: DataFrame) -> DataFrame:
    """sets with lone, the values of the shingles that no other set holds, without the sets whose prefix holds no others."""
    lone = held.where("n = 1").groupBy("id").agg(F.collect_list("value").alias("lone"))
    known = sets.join(lone, "id", "left").withColumn("lone", F.coalesce("lone", F.array().cast("array<long>")))
    return known.where(F.size("lone") <= F.col("size") - F.floor((LEAST * F.col("size") + 99) / 100))


def common(z: bytes, lone: list[int]) -> tuple[np.ndarray, int]:
    """The shingles of a set that others hold, and the size of the set."""
    h = unpacked(z)
    if not lone:
        return h, len(h)
    return h[~np.isin(_mixed(h, 0) >> CUT, np.array(lone, np.int64).view(np.uint64))], len(h)


def prefix_of_common(h: np.ndarray, size: int, order: int, late: Late) -> np.ndarray:
    """The prefix of a set of that size, of which h are common(), without its lone shingles."""
    return prefix(h, order, late, prefix_size(size) - size + len(h))


def late_shingles(shared: DataFrame) -> Late:
    """The shingles of MOST_LAST at most that the most sets hold. shared: value (under the plain order), n (sets)."""
    often = shared.where(F.col("n") >= LATE).select("value", F.floor(F.log2("n")).cast("int").alias("level"))
    total, least = 0, None
    for level, n in sorted(map(tuple, often.groupBy("level").count().collect()), reverse=True):  # 60 rows at most
        if (total := total + n) > MOST_LAST:
            break
        least = level
    if least is None:
        return Late(np.empty(0, np.uint64), np.empty(0, np.int32))
    got = often.where(F.col("level") >= least).toArrow()
    return Late(got.column("value").to_numpy().view(np.uint64), got.column("level").to_numpy())


def buckets(sets: DataFrame, late) -> DataFrame:
    """(id, key): the nodes that share a prefix shingle under the first of the orders that put common shingles last. Shingles with the same nodes have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            lists = [prefix_of_common(*common(z, lone), 1, late.value) for z, lone in zip(t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t.column(0).to_numpy(), [len(x) for x in lists])), _longs(lists).values], ["id", "value"])

    cells = materialise(sets.select("id", "z", "lone").mapInArrow(run, "id long, value long"), "jaccard-cells")
    alike = F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(1))))
    of_value = cells.groupBy("value").agg(F.count("*").alias("n"), alike.alias("key")).where("n > 1").drop("n")
    got = materialise(cells.join(of_value, "value").select("id", "key").distinct(), "jaccard-members")
    drop(cells)
    return got


def joined(pairs: DataFrame, sets: DataFrame, late) -> DataFrame:
    """The pairs (a, b) of nodes that pass the other orders' filters and are linked. An a meets its b's in tasks of STAR at most."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("g"))
    dealt = pairs.join(stars, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("g")).cast("int"))
    heads = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("salt"), F.lit(0).alias("turn"), F.col("a").alias("id"))
    want = heads.unionByName(dealt.select("a", "salt", F.lit(1).alias("turn"), F.col("b").alias("id")))
    rows = want.join(sets.select("id", "z", "lone"), "id").select("a", "salt", "turn", "id", "z", "lone")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, size, filters = None, None, 0, []
        for t in batches:
            found = []
            for a, turn, b, z, lone in zip(*(t.column(n).to_pylist() for n in ("a", "turn", "id", "z", "lone")), strict=True):
                h, n = common(z, lone)
                if turn == 0:
                    head, own, size = a, h, n
                    filters = [(k, prefix_of_common(own, size, k, late.value)) for k in range(2, ORDERS + 1)]
                elif linked(size, n, min(len(own), len(h))) and all(np.isin(prefix_of_common(h, n, k, late.value), f).any() for k, f in filters) and linked(size, n, overlap(own, h)):
                    found.append((head, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


class Sharing:
    """Which of several lists of values share one with a given list."""

    def __init__(self, lists: list[np.ndarray]):
        self.size = np.array([len(x) for x in lists])
        self.first = np.cumsum(self.size) - self.size
        _, self.value = np.unique(np.concatenate(lists), return_inverse=True)
        self.mark = np.zeros(len(self.value) + 1, bool)

    def count(self, k: int) -> np.ndarray:
        own = self.value[self.first[k] : self.first[k] + self.size[k]]
        self.mark[own] = True
        both = np.add.reduceat(self.mark[self.value], self.first, dtype=np.int64)
        self.mark[own] = False
        return both


def block_links(node: list[int], root: list[int], block: list[int], sets: list[np.ndarray], late: Late, sizes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the classes of one pair of blocks: nodes of different blocks, or of one block where there is only one. sizes: of the whole sets, if sets lack lone shingles."""
    held, label, block = np.array([len(x) for x in sets]), np.unique(np.array(root), return_inverse=True)[1], np.array(block)
    sizes = held if sizes is None else np.array(sizes)
    alone, whole, out = len(set(block.tolist())) == 1, None, []
    filters = [Sharing([prefix_of_common(x, n, k, late) for x, n in zip(sets, sizes.tolist(), strict=True)]) for k in range(1, ORDERS + 1)]
    for k in range(len(sets)):
        near = (label != label[k]) & (alone | (block != block[k])) & linked(sizes, sizes[k], np.minimum(held, held[k]))
        near[: k + 1] = False
        for f in filters:
            if near.any():
                near &= f.count(k) > 0
        at = np.flatnonzero(near)
        if len(at) > 4:
            whole = whole or Sharing(sets)
            both = whole.count(k)[at]
        else:
            both = np.array([overlap(sets[k], sets[j]) for j in at.tolist()], np.int64)
        for j in at[linked(sizes[at], sizes[k], both)].tolist():
            if label[j] != label[k]:
                label[label == label[j]] = label[k]
                out.append((node[k], node[j]))
    return out


def in_blocks(live: DataFrame, sets: DataFrame, late, wide: int = WIDE) -> DataFrame:
    """(a, b): links between classes of each group's nodes. live: id, root, key (of the group) and the group's n (nodes) and total (their shingles)."""
    blocks = F.greatest(F.ceil(F.col("n") / wide), F.ceil(F.col("total") / HEAVY)).cast("int")
    dealt = live.withColumn("g", blocks).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("g")).cast("int"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "id", "root", "block")
    met = met.join(sets.select("id", "z", "lone"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [], [])

        def close():
            got = block_links(*held[:4], late.value, held[4]) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        for t in batches:
            for key, i, j, *row in zip(*(t.column(n).to_pylist() for n in ("key", "i", "j", "id", "root", "block", "z", "lone")), strict=True):
                if (key, i, j) != now and now is not None:
                    yield close()
                    held = [], [], [], [], []
                now = key, i, j
                for kept, x in zip(held, (*row[:3], *common(*row[3:])), strict=True):
                    kept.append(x)
        if now is not None:
            yield close()

    return met.mapInArrow(run, "a long, b long")


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """members (id, key and more) of the buckets that hold several classes, with root, and the bucket's lo, hi and n (and total of sizes)."""
    if roots is None:
        seen = members.withColumn("root", F.col("id"))
    else:
        seen = members.join(roots.select(F.col("node").alias("r_node"), "root"), F.col("id") == F.col("r_node"), "left").drop("r_node").withColumn("root", F.coalesce("root", "id"))
    end = F.struct("id", "root")
    total = [F.sum("size").alias("total")] if "size" in members.columns else []
    stats = seen.groupBy("key").agg(F.min(end).alias("lo"), F.max(end).alias("hi"), F.count("*").alias("n"), *total, (F.min("root") != F.max("root")).alias("open"))
    return seen.join(stats.where("open").drop("open"), "key")


def _groups(live: DataFrame, roots: DataFrame, sets: DataFrame, wide: int) -> DataFrame:
    """What in_blocks() takes for the open buckets live (id, key, root, lo, n): groups in which all their pairs meet.

    Near copies share many buckets, which hold the same pairs again and again. So buckets whose least nodes have the same home,
    the largest bucket of a node, make a family. A family is compared as one group where that ships fewer texts than its
    buckets do; else they are compared, those of more than a block cut by size.
    """
    blocks = F.greatest(F.ceil(F.col("n") / wide), F.ceil(F.col("total") / HEAVY))
    homes = live.groupBy("id").agg(F.max_by("key", F.struct("n", "key")).alias("family"))
    families = live.where(F.col("id") == F.col("lo.id")).join(homes, "id").select("key", "family")
    sized = live.select("id", "key", "root", "n").join(families, "key").join(sets.select("id", "size"), "id")
    own = F.floor(F.log("size") / SIZE_CLASS)
    classes = F.when(F.col("n") > wide, F.array(own, own - 1)).otherwise(F.array(F.lit(0).cast("long")))
    cut = sized.select("id", "size", "family", F.explode(classes).alias("c"), "key").select("id", "size", "family", F.xxhash64("key", "c").alias("key"))
    parts = materialise(_open(cut, roots).select("id", "size", "root", "family", "key", "n", "total"), "jaccard-parts")
    whole = parts.groupBy("family", "id").agg(F.first("size").alias("size"), F.first("root").alias("root"))
    sums = whole.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    cost = parts.groupBy("family").agg(F.sum(blocks).alias("apart"))
    chosen = materialise(sums.join(cost, "family").withColumn("one", F.col("n") * blocks <= F.col("apart")), "jaccard-chosen")
    together = whole.join(chosen.where("one"), "family").select("id", "root", F.col("family").alias("key"), "n", "total")
    apart = parts.join(chosen.where("not one").select("family"), "family").select("id", "root", "key", "n", "total")
    return together.unionByName(apart)


def links(members: DataFrame, sets: DataFrame, late, wide: int = WIDE) -> DataFrame:
    """(a, b): links that span every class of nodes. members: buckets()."""
    live = materialise(_open(members, None), "jaccard-live")
    other = live.where("root != lo.root").groupBy("id", F.col("lo.id").alias("p")).count()
    best = other.groupBy("id").agg(F.max_by("p", F.struct("count", "p")).alias("a")).select("a", F.col("id").alias("b"))
    found = materialise(joined(best, sets, late), "jaccard-links")
    roots = materialise(components(found).distinct(), "jaccard-roots")
    left = materialise(_open(live.select("id", "key"), roots), "jaccard-live")
    drop(live)
    groups = materialise(_groups(left, roots, sets, wide), "jaccard-groups")
    out = materialise(found.unionByName(in_blocks(groups, sets, late, wide)), "jaccard-links")
    drop(left, roots, groups, found)
    return out


def join(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    rows = materialise(prints(docs), "jaccard-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    nodes = rows.where("size > 0").groupBy("node").agg(F.min(rank).alias("r"), F.first("size").alias("size"), F.first("first").alias("first"))
    nodes = nodes.select("node", "size", F.col("r.doc_id").alias("k_id"), F.col("r.text_hash").alias("k_hash"), "first")
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "jaccard-nodes")  # small numbers shuffle in fewer bytes
    cells = nodes.select("id", F.explode("first").alias("value"))
    shared = materialise(cells.groupBy("value").count().where("count > 1").select("value"), "jaccard-shared")
    some = cells.join(shared, "value").groupBy("id").agg(F.count("*").alias("shared"))
    want = nodes.join(some, "id").where(F.col("shared") >= shared_at_least(F.col("size"))).select("id", "size", "k_id", "k_hash")
    want = materialise(want, "jaccard-want")
    drop(shared)
    sets = materialise(packed(docs, want), "jaccard-sets")
    if sets.count() != want.count():  # repeated rows
        once = materialise(sets.dropDuplicates(["id"]), "jaccard-sets")
        drop(sets)
        sets = once
    held = materialise(held_by(sets), "jaccard-held")
    late = spark.sparkContext.broadcast(late_shingles(held))
    whole, sets = sets, materialise(with_lone(sets, held), "jaccard-sets")
    drop(whole, held)
    members = buckets(sets, late)
    found = links(members, sets, late, wide)
    roots = components(found).distinct().withColumnRenamed("node", "r_node")
    best = nodes.select("id", "node", F.col("k_id").alias("best")).join(roots, F.col("id") == F.col("r_node"), "left").select("node", "best", F.coalesce("root", "id").alias("root"))
    best = materialise(best, "jaccard-best")
    ids = best.join(best.groupBy("root").agg(F.min("best").alias("component_id")), "root").select("node", "component_id")
    ids = materialise(ids, "jaccard-ids")
    drop(sets, members, want, nodes, best, found)
    got = rows.select("doc_id", "size", "node").join(ids, "node", "left")
    return got.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
k AS MATERIALIZED (SELECT s, CASE WHEN len(s) = 0 THEN r END AS own, row_number() OVER () AS node, min(doc_id) AS least FROM s GROUP BY s, CASE WHEN len(s) = 0 THEN r END),
x AS MATERIALIZED (SELECT node, len(s) AS n, hash(unnest(s)) AS h FROM k),
c AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.h = b.h AND a.node < b.node WHERE 100 * least(a.n, b.n) >= {LEAST} * greatest(a.n, b.n) GROUP BY a.node, b.node),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * shared >= {LEAST} * (na + nb - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT node AS a, node AS b FROM k UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
m AS (SELECT reach.a AS node, min(least) AS component_id FROM reach JOIN k ON k.node = reach.b GROUP BY reach.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN k ON k.s = s.s AND k.own IS NOT DISTINCT FROM CASE WHEN len(s.s) = 0 THEN s.r END JOIN m ON m.node = k.node
"""
