"""Language-model scoring with the recurrent model of gru.py, trained on the corpus itself.

1. Each task cuts its texts into blocks of about BLOCK_CHARS characters: the block's own word list with
   word counts over training texts, parted into buckets by the words' CRC32, and its texts as numbers.
2. The lists of a bucket meet and are counted by the words' 64-bit XXH64. The most frequent words,
   PER_ROOT times the root of the number of distinct ones and HEAD at least, make the head; their counts
   and the mass of each frequency bin go to the driver.
3. Each block gets its words' counts back and becomes model codes, with the unigram base scores.
4. ROUNDS rounds of training: every task trains from the shared parameters on its share of every
   block, all training texts being used once over the rounds; parameters are averaged, weighted by
   tokens, in two levels so that no task reads more than the square root of the blocks.
5. Every text is scored whole.

What is gathered grows with the corpus: word lists of all texts, gradients from all training texts.
Null and empty texts are the end token alone. A null doc_id counts as empty for the fold. Repeated
rows count as often as they occur. With no training text N is 0, every word is unknown and the model
stays at its start. Words that training texts never use share one code and half of the mass of words
seen once (all of it if there are none), as one event, as in the base score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import gru
from .common import drop, materialise, ship, table

FOLDS, HELD_FOLD = 5, 1
BLOCK_CHARS, HEAD, PER_ROOT, ROUNDS, RATE, CHUNKS = 12_000_000, 1024, 2.0, 3, 0.01, 16
#: Words are counted in buckets: one for so many documents, within bounds that keep both a list and a bucket small.
BUCKET_DOCS, LEAST_BUCKETS, MOST_BUCKETS = 1000, 64, 65536
END_HASH = xxh64_intdigest(b"")


def _numbered(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, numbers, lengths): the distinct words of all texts, the end before them, and every text's words and its end as numbers into them.

    Words are those of common.words_of(), split and looked up by Arrow.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.not_equal(pc.binary_length(words), 0)  # white space at either end of a text splits off an empty word
    coded = words.filter(some).dictionary_encode()
    lengths = np.bincount(owner.filter(some).to_numpy(), minlength=len(texts)) + 1
    numbers, is_word = np.zeros(int(lengths.sum()), np.uint32), np.ones(int(lengths.sum()), bool)
    is_word[np.cumsum(lengths) - 1] = False
    numbers[is_word] = coded.indices.to_numpy() + 1
    found = coded.dictionary.cast(pa.large_binary())
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, "<i8")[found.offset : found.offset + len(found) + 1].tolist() if len(found) else []
    data = data.to_pybytes() if data else b""
    return [b"", *(data[i:j] for i, j in pairwise(at))], numbers, lengths


def _list_of(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _cut(docs: DataFrame, block_chars: int, buckets: int) -> DataFrame:
    """Two kinds of rows. Blocks: bid, doc_ids, held, n_tokens, ids (numbers into the block's words).

    Lists: bid, bucket, h and n: the hashes of the block's words of a bucket and their counts in training texts. A block numbers its words
    in the order of its lists.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    names = ["bid", "doc_ids", "held", "n_tokens", "ids", "bucket", "h", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid = TaskContext.get().partitionId() << 24

        def block():
            known, flat, lengths = _numbered(pa.concat_arrays(texts))
            out = np.concatenate(held)
            counts = np.bincount(flat[np.repeat(~out, lengths)], minlength=len(known))
            h = np.fromiter((xxh64_intdigest(w) for w in known), np.uint64, len(known))
            bucket = np.fromiter(map(crc32, known), np.int64, len(known)) * buckets >> 32
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order))
            edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            of_list = lambda x, t: pa.array([y.tobytes() for y in np.split(x[order].astype(t), edge[1:])], pa.binary())
            owned = pa.concat_arrays(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([bid]), _list_of(owned), _list_of(pa.array(out)), _list_of(pa.array(lengths)), pa.array([number[flat].astype("<u4").tobytes()], pa.binary()), pa.nulls(1, pa.int32()), *(pa.nulls(1, pa.binary()),) * 2], names)
            k = len(edge)
            yield pa.RecordBatch.from_arrays([pa.array([bid] * k), pa.nulls(k, pa.list_(owned.type)), pa.nulls(k, pa.list_(pa.bool_())), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.binary()), pa.array(bucket[order][edge].astype(np.int32)), of_list(h, "<u8"), of_list(counts, "<i8")], names)

        texts, doc_ids, held, size = [], [], [], 0
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy().astype(np.int64))
            first, before = 0, 0
            while first < b.num_rows:
                # a block ends behind the text that fills it
                last = min(int(np.searchsorted(ends, before + block_chars - size)) + 1, b.num_rows)
                texts.append(b.column(1).slice(first, last - first))
                doc_ids.append(b.column(0).slice(first, last - first))
                held.append(b.column(2).slice(first, last - first).to_numpy(zero_copy_only=False))
                size += int(ends[last - 1]) - before
                first, before = last, int(ends[last - 1])
                if size >= block_chars:
                    yield from block()
                    bid += 1
                    texts, doc_ids, held, size = [], [], [], 0
        if texts:
            yield from block()

    slim = docs.select("doc_id", "text", (fold == HELD_FOLD).alias("held"))
    return slim.mapInArrow(run, f"bid long, doc_ids array<{kind}>, held array<boolean>, n_tokens array<long>, ids binary, bucket int, h binary, n binary")


def _word_counts(blocks: DataFrame) -> DataFrame:
    """The lists meet by bucket, one bucket in memory at a time. Three kinds of rows:

    for each list bid, bucket, places and counts (over all training texts) of its words; for each word that occurs twice or more, and for
    the end, bucket, place, h and c; for each bucket tokens and distinct: the mass and the words of each frequency bin.
    """
    types = {"bid": pa.int64(), "bucket": pa.int32(), "places": pa.binary(), "counts": pa.binary(), "place": pa.int32(), "h": pa.int64(), "c": pa.int64(), "tokens": pa.list_(pa.int64()), "distinct": pa.list_(pa.int64())}

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()], list(types))

    def close(bucket: int, bids: list[int], hs: list[bytes], ns: list[bytes]) -> Iterator[pa.RecordBatch]:
        h = np.frombuffer(b"".join(hs), "<u8")
        words, place = np.unique(h, return_inverse=True)
        c = np.zeros(len(words), np.int64)
        np.add.at(c, place, np.frombuffer(b"".join(ns), "<i8"))
        edge = np.cumsum([len(x) // 8 for x in hs])[:-1]
        split = lambda x, t: [y.tobytes() for y in np.split(x.astype(t), edge)]
        yield rows(bid=bids, bucket=[bucket] * len(bids), places=split(place, "<i4"), counts=split(c[place], "<i8"))
        shown = np.flatnonzero((c > 1) | (words == END_HASH))
        yield rows(bucket=np.full(len(shown), bucket, np.int32), place=shown.astype(np.int32), h=words[shown].view(np.int64), c=c[shown])
        own = c[c > 0]
        b = np.frexp(own.astype(float))[1] - 1
        mass, distinct = np.zeros(64, np.int64), np.bincount(b, minlength=64)
        np.add.at(mass, b, own)
        yield rows(bucket=[bucket], tokens=[mass.tolist()], distinct=[distinct.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for b in batches:
            for bucket, *row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != now and now is not None:
                    yield from close(now, *held)
                    held = [], [], []
                now = bucket
                for kept, x in zip(held, row, strict=True):
                    kept.append(x)
        if now is not None:
            yield from close(now, *held)

    lists = blocks.where("bucket is not null").select("bucket", "bid", "h", "n").repartition("bucket").sortWithinPartitions("bucket", "bid")
    return lists.mapInArrow(run, "bid long, bucket int, places binary, counts binary, place int, h long, c long, tokens array<long>, distinct array<long>")


class Vocabulary:
    """counts: of the head words, by code. keys, codes: the head words' bucket and place in it as one number, ascending, and their codes.

    mass: tokens of each tail bin. n, v: tokens and distinct tokens in training texts; ones: words seen once in the tail.
    """

    def __init__(self, counts: list[int], keys: list[int], end: int, bins: list[tuple[int, int, int]]):
        self.n, self.v, self.end = sum(b[1] for b in bins), sum(b[2] for b in bins), end
        self.counts, own = np.array(counts, np.int64), np.array(keys, np.int64)
        self.codes = np.argsort(own)
        self.keys = own[self.codes]
        self.mass, words = np.zeros(gru.BINS), np.zeros(gru.BINS)
        for b, tokens, distinct in bins:  # the last bin takes all that are more frequent
            self.mass[min(b, gru.BINS - 1)] += tokens
            words[min(b, gru.BINS - 1)] += distinct
        for c in counts:
            if c:
                b = min(int(c).bit_length() - 1, gru.BINS - 1)
                self.mass[b] -= c
                words[b] -= 1
        self.ones = words[0]
        self.width = "<u2" if len(counts) + gru.BINS <= 1 << 16 else "<u4"

    def codes_of(self, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
        tail = len(self.counts) + np.clip(np.frexp(np.maximum(c, 1).astype(float))[1] - 1, 0, gru.BINS - 1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.codes[at], tail)

    def tail_logs(self, codes: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its bin; 0 for head words."""
        head = len(self.counts)
        b = np.maximum(codes - head, 0)
        share = np.maximum(c, 1) / np.maximum(self.mass[b], 1)
        rare = np.where(c == 0, 0.5 if self.ones else 1.0, 0.5 / max(self.ones, 1))
        return np.where(codes < head, 0.0, np.log10(np.where(b == 0, rare, share)))


def head_size(v: int, least: int = HEAD, per_root: float = PER_ROOT) -> int:
    """Head words for v distinct training words: it grows as their square root, as the classes of the softmax do."""
    return max(least, int(np.ceil(per_root * v**0.5)))


def _vocabulary(counts: DataFrame, least: int) -> Vocabulary:
    bins = counts.where("tokens is not null").select(F.posexplode(F.arrays_zip("tokens", "distinct")).alias("b", "x")).groupBy("b").agg(F.sum("x.tokens"), F.sum("x.distinct")).collect()  # 64 rows
    words = counts.where("place is not null").select("h", "c", "bucket", "place")
    is_end = F.col("h") == int(np.uint64(END_HASH).view(np.int64))
    v = sum(r[2] for r in bins)
    top = words.where(~is_end & (F.col("c") > 0)).orderBy(F.desc("c"), "h").limit(head_size(v, least) - 1).collect()
    end = words.where(is_end).collect()
    ranked = sorted([*(tuple(r) for r in top), *(tuple(r) for r in end)], key=lambda x: (-x[1], x[0])) or [(0, 0, 0, 0)]
    ends = [k for k, x in enumerate(ranked) if end and x[0] == end[0][0]] or [0]
    return Vocabulary([x[1] for x in ranked], [x[2] << 32 | x[3] for x in ranked], ends[0], sorted(tuple(r) for r in bins))


def _coded(blocks: DataFrame, counts: DataFrame, vocabulary) -> DataFrame:
    """bid, doc_ids, held, n_tokens, n_known, base, tail, codes."""
    lists = counts.where("bid is not null").groupBy("bid").agg(F.array_sort(F.collect_list(F.struct("bucket", "places", "counts"))).alias("m"))  # a block's words: bounded by BLOCK_CHARS
    joined = blocks.where("bucket is null").drop("bucket", "h", "n").join(lists, "bid")
    kind = blocks.schema["doc_ids"].dataType.simpleString()
    names = ["bid", "doc_ids", "held", "n_tokens", "n_known", "base", "tail", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary.value
        for b in batches:
            at = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            for k in range(b.num_rows):
                bucket, places, counts = (at["m"][k].values.field(x) for x in ("bucket", "places", "counts"))
                place, c = np.frombuffer(b"".join(places.to_pylist()), "<i4"), np.frombuffer(b"".join(counts.to_pylist()), "<i8")
                per_list = np.array([len(x) // 4 for x in places.to_pylist()])
                code = voc.codes_of(np.repeat(bucket.to_numpy().astype(np.int64), per_list) << 32 | place, c)
                ids = np.frombuffer(at["ids"][k].as_buffer(), "<u4")
                n = np.asarray(at["n_tokens"][k].values, np.int64)
                first = np.cumsum(n) - n
                base = np.log10((c + 0.5) / (voc.n + 0.5 * (voc.v + 1)))
                sums = [np.add.reduceat(x[ids], first) for x in ((c > 0).astype(np.int64), base, voc.tail_logs(code, c))]
                yield pa.RecordBatch.from_arrays([at["bid"].slice(k, 1), at["doc_ids"].slice(k, 1), at["held"].slice(k, 1), at["n_tokens"].slice(k, 1), *(_list_of(pa.array(x)) for x in sums), pa.array([code.astype(voc.width)[ids].tobytes()], pa.binary())], names)

    return joined.mapInArrow(run, f"bid long, doc_ids {kind}, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, tail array<double>, codes binary")


def _round(coded: DataFrame, vec: np.ndarray, voc_size: int, width: str, end: int, number: int, rounds: int, salts: int) -> np.ndarray:
    """The parameters, averaged over all tasks' training on every rounds-th training text from `number` on."""
    held = coded.sparkSession.sparkContext.broadcast(vec)
    rate = RATE / (1 + number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens, salt = held.value, 0, None
        for b in batches:
            for k in range(b.num_rows):
                n = np.asarray(b.column(2)[k].values, np.int64)
                use = ~np.asarray(b.column(1)[k].values.to_numpy(zero_copy_only=False), bool) & (np.arange(len(n)) % rounds == number)
                codes = np.frombuffer(b.column(3)[k].as_buffer(), width)[np.repeat(use, n)]
                own = gru.train(own, voc_size, end, codes, rate)
                tokens += len(codes)
                salt = b.column(0)[k].as_py() % salts if salt is None else salt
        if tokens:
            parts = np.array_split(own, CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int64()), pa.array([float(tokens)] * CHUNKS), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())], ["chunk", "salt", "w", "v"])

    def mean(pdf):
        w = pdf["w"].to_numpy()
        total = sum(x * np.frombuffer(v, "<f4").astype(float) for x, v in zip(w, pdf["v"], strict=True)) / w.sum()
        return pdf.iloc[:1].assign(w=w.sum(), v=[total.astype("<f4").tobytes()])

    schema = "chunk int, salt long, w double, v binary"
    got = coded.select(F.abs(F.xxhash64("bid")).alias("h"), "held", "n_tokens", "codes").mapInArrow(run, schema)
    got = got.groupBy("chunk", "salt").applyInPandas(mean, schema).groupBy("chunk").applyInPandas(mean, schema)
    chunks = sorted((r[0], bytes(r[3])) for r in got.collect())  # one vector of fixed length
    return np.concatenate([np.frombuffer(v, "<f4") for _, v in chunks]) if chunks else vec


def score(docs: DataFrame, head: int = HEAD, block_chars: int = BLOCK_CHARS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    buckets = int(np.clip(docs.count() // BUCKET_DOCS, LEAST_BUCKETS, MOST_BUCKETS))
    blocks = materialise(_cut(docs, block_chars, buckets), "lm-blocks")
    counts = materialise(_word_counts(blocks), "lm-counts")
    voc = _vocabulary(counts, head)
    coded = materialise(_coded(blocks, counts, spark.sparkContext.broadcast(voc)), "lm-coded")
    drop(blocks, counts)
    size, end, width = len(voc.counts), voc.end, voc.width
    salts = int(np.ceil(np.sqrt(max(1, coded.count()))))
    vec = gru.start(voc.counts, voc.mass)
    for number in range(rounds):
        vec = _round(coded, vec, size, width, end, number, rounds, salts)
    held = spark.sparkContext.broadcast(vec)
    kind = coded.schema["doc_ids"].dataType.elementType.simpleString()
    n_train = voc.n
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                doc_ids, is_held, n, known, base, tail, codes = (b.column(i)[k] for i in range(7))
                lengths = np.asarray(n.values, np.int64)
                got = gru.score(held.value, size, end, np.frombuffer(codes.as_buffer(), width).astype(np.int64), lengths) + np.asarray(tail.values)
                yield pa.RecordBatch.from_arrays([doc_ids.values, is_held.values, n.values, known.values, pa.array(np.full(len(lengths), n_train, np.int64)), base.values, pa.array(got)], names)

    slim = coded.select("doc_ids", "held", "n_tokens", "n_known", "base", "tail", "codes")
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
