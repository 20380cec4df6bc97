"""Token ids in a binary format: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

File format: a Parquet table of blocks in ascending order (part, block); before: the ids of the part's
earlier blocks. A block holds the documents doc_ids with n_tokens ids each; ids become ranks (0: the most frequent id of the corpus); control has
two bits for each rank, four to a byte from the low end: its number of bytes less one; data has those
bytes, low first. A second table, ranks, holds (rank, id). Decoding looks up, for each control byte,
the four lengths, and gathers the bytes with numpy.

Null and empty texts: the end id alone. Rows are ordered by doc_id, nulls first; repeated doc_ids stay
next to each other in any order (ties), spread over partitions by a seeded random number so that none
grows too large. An empty table gives empty files. Very long texts are encoded whole. Columns other
than doc_id and text are not read, whatever their names. The rank table is bounded by the vocabulary.

Texts are encoded where they lie; only their ids are sorted by doc_id and written in the file format.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialise, ship, table
from .encoding import encoder, text_batches

TOKENIZER, END_ID, BLOCK_CHARS, BLOCK_IDS, CHUNKS = "byte_bpe_50k.json", 2, 1_000_000, 250_000, 800_000
#: LENGTHS[c]: bytes of the four values of control byte c. MASKS[n]: the bits of an n-byte value.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_ints(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of values below 2**32."""
    v = np.ascontiguousarray(values, "<u4")
    small = int(v.max(initial=0)) <= 0xFFFF
    size = 1 + (v > 0xFF).astype(np.uint8)
    if not small:
        size += (v > 0xFFFF) + (v > 0xFFFFFF).astype(np.uint8)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = 2 if small else 4
    kept = np.arange(width) < size[:, None] if not small else np.stack([np.ones(len(v), bool), size == 2], 1)
    return control.astype(np.uint8).tobytes(), v.astype(f"<u{width}").view(np.uint8)[kept.ravel()].tobytes()


def unpack_ints(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64 if len(size) >= 1 << 29 else np.int32) - size
    d = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = d[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        out |= d[at + k].astype(np.uint32) << np.uint32(8 * k)
    return out & MASKS[size]


def _encode(docs: DataFrame, tokenizer_path: str | None) -> DataFrame:
    """doc_id, n (ids with the end), ids of every row; each task ends with a row of counts: how often it met each id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(TOKENIZER, END_ID, False, tokenizer_path, CHUNKS)
        width = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        total, names, doc_type = np.zeros(0, np.int64), ["doc_id", "n", "ids", "counts"], None
        for b in batches:
            doc_type = b.column(0).type
            for first, texts in text_batches(b.column(1), BLOCK_CHARS):
                ids, n = enc.encode(texts)
                got = np.bincount(ids, minlength=len(total))
                got[: len(total)] += total
                total = got
                data, ends = ids.astype(width), np.cumsum(n)
                parts = [data[x:y].tobytes() for x, y in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(n), pa.array(parts, pa.binary()), pa.nulls(len(texts), pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, ids binary, counts binary")


def _ranks(raw: DataFrame) -> list[int]:
    """Ids by falling count in the corpus; at most the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for one in b.column(0):
                got = np.frombuffer(one.as_buffer(), "<i8")
                more = np.zeros(max(len(got), len(total)), np.int64)
                more[: len(got)] = got
                more[: len(total)] += total
                total = more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = raw.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r[0] for r in sorted(map(tuple, counts.collect()), key=lambda x: (-x[1], x[0]))]


def write(docs: DataFrame, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The two tables of the file format, written to the shared folder: blocks, and ranks."""
    spark = docs.sparkSession
    ship(spark)
    raw = materialise(_encode(docs, tokenizer_path), "token-raw", "zstd")
    by_rank = _ranks(raw)
    ranks = materialise(spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long").coalesce(1), "token-ranks")
    rank_of = np.zeros(1 + max(by_rank, default=0), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    held = spark.sparkContext.broadcast(rank_of)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["part", "block", "before", "doc_ids", "n_tokens", "control", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, part, block, before = held.value, TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // BLOCK_IDS)) + 1
            for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(n)].tolist(), strict=True):
                if i == j:
                    continue
                rows, own = b.column(2).slice(i, j - i).to_pylist(), int(n[i:j].sum())
                ids = np.frombuffer(b"".join(rows), "<u2" if sum(map(len, rows)) == 2 * own else "<u4")
                control, data = pack_ints(rank_of[ids])
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), one(b.column(0).slice(i, j - i)), one(pa.array(n[i:j])), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names)
                block, before = block + 1, before + own

    order = [F.asc_nulls_first("doc_id"), F.asc("__r")]
    rows = raw.where("n is not null").select("doc_id", "n", "ids", F.rand(7).alias("__r"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__r")
    coded = rows.mapInArrow(run, f"part int, block int, before long, doc_ids array<{kind}>, n_tokens array<long>, control binary, data binary")
    blocks = materialise(coded, "token-files")
    drop(raw)
    return blocks, ranks


def read(blocks: DataFrame, ranks: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, and ids (array<int>) or, with digest, ids_crc32."""
    spark = blocks.sparkSession
    ship(spark)
    id_of = np.array([r[1] for r in sorted(map(tuple, ranks.select("rank", "id").collect()))], np.uint32)  # at most the vocabulary
    base, done = {}, 0
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)))
    for part, n in sorted(map(tuple, parts.collect())):  # a number for each partition
        base[part], done = done, done + n
    held = spark.sparkContext.broadcast((id_of, base))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of, base = held.value
        for b in batches:
            for r in range(b.num_rows):
                part, before, doc_ids, counts, control, data = (b.column(k)[r] for k in range(6))
                n = np.asarray(counts.values, np.int64)
                ids = id_of[unpack_ints(control.as_py(), data.as_py(), int(n.sum()))].astype("<u4")
                ends = np.cumsum(n)
                first = ends - n
                if digest:
                    view = memoryview(ids.view(np.uint8))
                    last = pa.array([crc32(view[4 * x : 4 * y]) for x, y in zip(first.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(base[part.as_py()] + before.as_py() + first), pa.array(n), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    last = "ids_crc32 long" if digest else "ids array<int>"
    return blocks.select("part", "before", "doc_ids", "n_tokens", "control", "data").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, {last}")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(*write(table(spark, sf_dir, "documents")), digest=True)
