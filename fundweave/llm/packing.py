"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are encoded and cut into pieces of at most CAPACITY tokens. A sequence that is begun has a
gap. A round takes the pieces of one size class (lengths from a power of two up to twice that; CLASSES rounds,
from the longest class to the shortest) and all gaps that may hold one:

1. Pieces and gaps are range-sorted together by size, largest first, and so dealt to partitions. In each
   the successor sweep goes down the order: a piece takes the least gap of its partition that holds it,
   and the gap that is left goes back to its place among the others.
2. A piece whose partition has no such gap goes to the gaps that partitions of larger sizes have left.
   Partitions report how many they have and the sizes' bounds, one row each, and the driver pairs
   intervals of such pieces with intervals of such gaps, the nearest larger partition first. Many pieces
   then want the same gaps: their ranks decide, `slots` neighbours in rank to a gap, where slots is the
   number of the interval's longest pieces that its least gap holds.
3. What found no gap opens new sequences by the same rule. All gaps are updated, and the next round begins.

Nothing that grows with the corpus but one row for each partition reaches the driver; a partition holds
about ROWS pieces and gaps, also where a third of all pieces have one length, as ties are dealt by doc_id.

Null and empty texts are a piece of the end token alone; very long texts are cut into as many pieces as
they need. Repeated rows are packed as often as they occur. Ties of length fall by doc_id, piece and
checksum. An empty table gives an empty result. Columns other than doc_id and text are not read,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, materialise, ship, table
from .encoding import encoder, text_batches

CAPACITY, TOKENIZER, END_ID = 2048, "word_bpe_49k.json", 0
#: Chunks that the encoder keeps; pieces and gaps of a partition in a round.
CHUNKS, ROWS = 500_000, 400_000
#: Size classes: the last takes all that is shorter.
CLASSES = 6


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document cut into pieces."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(TOKENIZER, END_ID, True, tokenizer_path, CHUNKS)
        for b in batches:
            for first, texts in text_batches(b.column(1)):
                ids, counts = enc.encode(texts)
                ids = ids.astype("<u4")
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(texts)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = np.repeat(np.cumsum(counts) - counts, n) + start
                view = memoryview(ids.view(np.uint8))
                crc = [crc32(view[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + first)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], is_gap: list[bool]) -> tuple[list[int], list[int]]:
    """Successor sweep down a partition: for each row its gap's row (-1: none; a gap: itself) and the gap's size before (a piece) or in the end (a gap).

    Rows are ordered by size, largest first, gaps before pieces.
    """
    target, room = [-1] * len(sizes), [0] * len(sizes)
    held: dict[int, list[int]] = {}  # gap size -> rows of such gaps
    order: list[int] = []  # the sizes, ascending

    def add(size: int, row: int) -> None:
        if size not in held:
            held[size] = []
            insort(order, size)
        held[size].append(row)

    for row, size in enumerate(sizes):
        if is_gap[row]:
            target[row], room[row] = row, size
            add(size, row)
            continue
        k = bisect_left(order, size)
        if k == len(order):
            continue
        gap = order[k]
        rows = held[gap]
        g = rows.pop()
        if not rows:
            del held[gap]
            order.pop(k)
        target[row], room[row], room[g] = g, gap, gap - size
        if gap > size:
            add(gap - size, g)
    return target, room


def pair(left: list[tuple[int, int, int, int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Which gaps the pieces left over take. left: (part, gaps, least gap, pieces, longest piece) of each partition, by part.

    Gives (piece part, first piece, gap part or -1 for new sequences, first gap, slots): the part's pieces from that one on take the gaps
    from that one on; and how many sequences are new.
    """
    open_, out, opened = [], [], 0  # open_: [part, first free gap, gaps, least gap], the nearest last
    for part, gaps, least, n, longest in left:
        done = 0
        while done < n and open_ and (slots := open_[-1][3] // longest):
            own, first, end, _ = open_[-1]
            took = min(end - first, -(-(n - done) // slots))
            out.append((part, done, own, first, slots))
            done += min(took * slots, n - done)
            open_[-1][1] += took
            if open_[-1][1] == end:
                open_.pop()
        if done < n:
            slots = capacity // longest
            out.append((part, done, -1, opened, slots))
            opened += -(-(n - done) // slots)
        if gaps:
            open_.append([part, 0, gaps, least])
    return out, opened


def _sweep(rows: DataFrame, n: int) -> DataFrame:
    """Range-sort by size and sweep each partition: adds part, place (in part, among the gaps left or the pieces without a gap), found (a piece: its sequence) and room."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        column = lambda name: t.column(name).combine_chunks()
        size, is_gap, seq = column("size").to_numpy(), column("is_gap").to_numpy(zero_copy_only=False).astype(bool), column("sequence_id").fill_null(0).to_numpy()
        if not len(size):
            return
        target, room = (np.array(x, np.int64) for x in best_fit(size.tolist(), is_gap.tolist()))
        found, place = np.where(target >= 0, seq[target], 0), np.full(len(size), -1)
        for some in (is_gap & (room >= size[-1]), ~is_gap & (target < 0)):  # such a gap holds whatever smaller partitions have
            place[some] = np.arange(some.sum())
        part = np.full(len(size), TaskContext.get().partitionId(), np.int32)
        more = [pa.array(part), pa.array(place), pa.array(found, mask=target < 0), pa.array(room)]
        yield from pa.Table.from_arrays([*t.columns, *more], [*t.schema.names, "part", "place", "found", "room"]).to_batches()

    order = [F.desc("size"), F.desc("is_gap"), F.asc_nulls_first("doc_id"), F.asc("piece"), F.asc("ids_crc32"), F.asc("sequence_id")]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, f"{columns}, part int, place long, found long, room long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, rows: int = ROWS) -> DataFrame:
    """pieces() with sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, capacity, tokenizer_path), "pieces")
    names = cut.columns
    top = capacity.bit_length() - 2
    power = F.greatest(F.lit(max(0, top - CLASSES + 1)), F.least(F.lit(top), F.floor(F.log2("length") + 1e-9))).cast("int")
    per_class = dict(map(tuple, cut.groupBy(power).count().collect()))  # CLASSES rows
    kinds = {f.name: f.dataType for f in cut.schema}
    placed, gaps, n_gaps, opened = [], None, 0, 0
    for k in sorted(per_class, reverse=True):
        low = 1 << k if k > max(0, top - CLASSES + 1) else 1
        own = cut.where(power == k).select(*names, F.col("length").alias("size"), F.lit(False).alias("is_gap"), F.lit(None).cast("long").alias("sequence_id"))
        if gaps is not None:
            nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in names]
            own = own.unionByName(gaps.where(F.col("gap") >= low).select(*nothing, F.col("gap").alias("size"), F.lit(True).alias("is_gap"), "sequence_id"))
        swept = materialise(_sweep(own, 1 + (per_class[k] + n_gaps) // rows), "packing-swept")
        free, lost = F.col("is_gap") & (F.col("place") >= 0), ~F.col("is_gap") & F.col("found").isNull()
        least = lambda c, of: F.coalesce(c(F.when(*of)), F.lit(0))
        left = swept.groupBy("part").agg(F.count_if(free), least(F.min, (free, F.col("room"))), F.count_if(lost), least(F.max, (lost, F.col("size"))))
        runs, new = pair(sorted(map(tuple, left.collect())), capacity)  # one row for each partition
        placed.append(swept.where(~F.col("is_gap") & F.col("found").isNotNull()).select(*names, F.col("found").alias("sequence_id"), (capacity - F.col("room")).alias("offset")))
        now = swept.where("is_gap").select("part", "place", "sequence_id", F.col("room").alias("gap"))
        if runs:
            ends = [b[1] if b[0] == a[0] else None for a, b in zip(runs, [*runs[1:], (-1, 0)], strict=True)]
            wanted = F.broadcast(spark.createDataFrame([(*r, end) for r, end in zip(runs, ends, strict=True)], "r_part int, r_first long, g_part int, g_first long, slots long, r_end long"))  # two rows at most for each partition
            mine = (F.col("part") == F.col("r_part")) & (F.col("place") >= F.col("r_first")) & (F.col("r_end").isNull() | (F.col("place") < F.col("r_end")))
            given = swept.where(lost).join(wanted, mine).withColumn("g_place", F.col("g_first") + F.floor((F.col("place") - F.col("r_first")) / F.col("slots")))
            by_gap = Window.partitionBy("g_part", "g_place", "slots").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # `slots` rows at most
            given = given.withColumn("before", F.coalesce(F.sum("size").over(by_gap), F.lit(0)))
            target = now.where("place >= 0").select(F.col("part").alias("g_part"), F.col("place").alias("g_place"), F.col("sequence_id").alias("own"), "gap")
            given = given.drop("sequence_id").join(target, ["g_part", "g_place"], "left")
            given = given.select(*names, F.coalesce("own", F.col("g_place") + opened).alias("sequence_id"), (F.coalesce(capacity - F.col("gap"), F.lit(0)) + F.col("before")).alias("offset"))
            placed.append(materialise(given, "packing-given"))
            filled = placed[-1].groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("filled"))
            now = now.join(filled, "sequence_id", "full").select("sequence_id", F.coalesce(capacity - F.col("filled"), F.col("gap")).alias("gap"))
            opened += new
        rest = now.select("sequence_id", "gap").where("gap > 0")
        old, gaps = gaps, materialise(rest if gaps is None else rest.unionByName(gaps.where(F.col("gap") < low)), "packing-gaps")
        drop(old)
        n_gaps = gaps.count()
    drop(gaps)
    if not placed:
        return cut.select("*", *(F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset")))
    return reduce(DataFrame.unionByName, placed)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
