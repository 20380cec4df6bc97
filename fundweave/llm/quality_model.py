"""Naive Bayes support vectors for text quality.

Indicators of hashed n-grams (word 1- and 2-grams, byte 3-grams, a word said twice or three times in a
row) are scaled by the classes' log-count ratios, brought to unit length and given to a linear
hinge-loss model, fitted by dual coordinate descent. A held-aside fifth of the sample turns margins
into probabilities (a logistic curve), which are then moved to the label rate of all labelled rows.

The model is fitted on a bounded sample of labelled rows: at most PER_CLASS of each label, those whose
doc_id hashes lowest; one text for each doc_id (the least, if it repeats). Its size does not depend on
the corpus; every text is scored. Tasks number the sample's features, one task fits; the driver sees the
sample's ids and the model (two numbers a feature), never the sample's texts or features. Only text enters a score. Null texts are empty: no n-gram, so the
score follows from the bias. Without labels every score is 1 (nothing speaks against a text); with one
label only, every score is that label. Label rows with null ids or labels other than 0 and 1 are left
out; a doc_id with both labels counts as 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, text_of, trim
from .encoding import release

PER_CLASS = 3000
DIM_BITS, GRAM_BITS = 20, 17
KEEP_AT = 0.7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_owner = np.zeros(1 << DIM_BITS, np.int32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64."""
    if len(_power[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            _power[k] = np.multiply.accumulate(x)
    return _power[0][:n], _power[1]


def features(text: str) -> np.ndarray:
    """Distinct feature numbers of a text."""
    a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(a):
        return np.empty(0, np.int64)
    found = []
    if len(a) > 2:
        x = a.astype(np.uint32)
        gram = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        found.append((gram >> np.uint32(32 - GRAM_BITS)).astype(np.int64))
    space = _SPACE[a]
    inside = np.r_[False, ~space, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if len(start):
        power, inverse = _powers(len(a))
        total = np.r_[np.uint64(0), np.cumsum((a + np.uint64(1)) * power)]
        word = (total[end] - total[start]) * inverse[start]
        word ^= word >> np.uint64(29)
        word *= np.uint64(0xBF58476D1CE4E5B9)
        first = 1 << GRAM_BITS
        found.append(first + (word >> np.uint64(64 - 18)).astype(np.int64))
        pair = (word[:-1] * np.uint64(3) + word[1:]) * np.uint64(0x94D049BB133111EB)
        found.append((1 << 19) + (pair >> np.uint64(64 - 19)).astype(np.int64))
        same = word[1:] == word[:-1]
        found.append(np.array([(1 << 19) - 1 - k for k, x in enumerate((same.any(), (same[1:] & same[:-1]).any())) if x], np.int64))
    ids = np.concatenate(found)
    place = np.arange(len(ids), dtype=np.int32)
    _owner[ids] = place
    return ids[_owner[ids] == place]


class Model:
    """margin(f) = sum of weight[f] over features / sqrt(sum of square[f]) + bias; score = logistic(slope * margin + shift)."""

    def __init__(self, weight, square, bias=0.0, slope=1.0, shift=0.0, constant=None):
        self.weight, self.square, self.bias, self.slope, self.shift, self.constant = weight, square, bias, slope, shift, constant

    def margin(self, f: np.ndarray) -> float:
        norm = float(self.square[f].sum())
        return self.bias + (float(self.weight[f].sum()) / norm**0.5 if norm > 0 else 0.0)

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        x = self.slope * self.margin(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|**2 / 2 + c * sum of hinge losses; rows have unit length, the bias is one more feature of value 1."""
    w, b, alpha, rng = np.zeros(dim), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            g = y[i] * (w[f] @ v + b) - 1
            new = min(max(alpha[i] - g / 2, 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[f] += step * v
                b += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1 | margin), with smoothed targets, by Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack([m, np.ones(len(m))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * (theta - [1.0, 0.0]))
        theta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, good_rate: float) -> Model:
    """rows: feature numbers of sampled texts; y: their labels; good_rate: labels 1 among all labelled rows."""
    dim = 1 << DIM_BITS
    if len(y) == 0 or len(set(y)) < 2:
        return Model(None, None, constant=float(y[0]) if len(y) else 1.0)
    aside = np.random.default_rng(11).permutation(len(y)) % 5 == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    own = np.flatnonzero(~aside)
    count = np.zeros((2, dim), np.int32)
    for i in own:  # what is set aside stays unseen until it calibrates
        count[y[i]][rows[i]] += 1
    seen = count.any(0)
    bad, good = (np.log(smooth / smooth.sum()) for smooth in count[:, seen] + 1.0)
    ratio = np.zeros(dim)
    ratio[seen] = good - bad
    del count, bad, good
    values = []
    for i in own:
        v = ratio[rows[i]].astype(np.float32)
        norm = float(np.sqrt(v @ v))
        values.append(v / norm if norm > 0 else v)
    w, b = dual_descent([rows[i] for i in own], values, np.where(y[own] == 1, 1.0, -1.0), dim)
    del values
    model = Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), b)
    test = np.flatnonzero(aside) if aside.any() else own
    model.slope, model.shift = _logistic(np.array([model.margin(rows[i]) for i in test]), y[test])
    rate = float(y[test].mean())
    good_rate = min(max(good_rate, 1e-3), 1 - 1e-3)
    model.shift += float(np.log(good_rate / (1 - good_rate)) - np.log(rate / (1 - rate)))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    good_rate = known.agg(F.avg("quality")).first()[0]
    picked = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not picked:
        return fit([], np.zeros(0, int), 0.5)
    sample = spark.createDataFrame([tuple(r) for r in picked], f"doc_id {known.schema['doc_id'].dataType.simpleString()}, quality int")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(text_of()).alias("text"), F.min("quality").alias("quality"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(v.as_py()).astype("<i4").tobytes() for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.binary())], ["doc_id", "quality", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        got = [(np.frombuffer(f.as_buffer(), "<i4"), q.as_py()) for b in batches for q, f in zip(*b.columns, strict=True)]
        model = pickle.dumps(fit([f for f, _ in got], np.array([q for _, q in got], int), good_rate))
        del got
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    numbered = texts.mapInArrow(number, f"doc_id {kind.simpleString()}, quality int, f binary").repartition(1).sortWithinPartitions("doc_id")  # 2 * per_class rows at most
    got = numbered.select("quality", "f").mapInArrow(learn, "model binary").collect()
    model = pickle.loads(got[0].model) if got else fit([], np.zeros(0, int), 0.5)
    del got
    trim()
    return model


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep` of every row, and score."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    kinds = "".join(f"c{i} {docs.schema[k].dataType.simpleString()}, " for i, k in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = held.value
        for b in batches:
            got = pa.array([m.score(v.as_py() or "") for v in b.column(b.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], [*b.schema.names[:-1], "score"])

    slim = docs.select(*(F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keep)), F.col("text").alias("__text"))
    return slim.mapInArrow(run, f"{kinds}score double").select(*(F.col(f"c{i}").alias(k) for i, k in enumerate(keep)), "score")


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the classifier does not reject."""
    wide = docs.select(*(F.col(f"`{c}`").alias(c if c == "text" else f"k{i}") for i, c in enumerate(docs.columns)))
    got = score(wide, train(docs, labels), *wide.columns).where(F.col("score") >= keep_at)
    return got.select(*(F.col(c if c == "text" else f"k{i}").alias(c) for i, c in enumerate(docs.columns)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
