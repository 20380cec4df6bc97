"""Runs of repeated words: Baier's grouping gives Lyndon arrays under both orders, Lyndon roots are extended through LCE.

A run is a stretch of words with smallest period q, of REPEATS periods and LEAST words at least, that no
neighbour extends. lyndon() is phase one of Baier's suffix sorter: suffixes are grouped by their longest
Lyndon prefix; groups are taken from the greatest down, each member is taken out of the list of open
positions, and the open position before it, whose prefix it continues, moves into the group of that prefix with as many
copies as members point to it. At the end each position's prefix is its longest Lyndon word. Every run
has a Lyndon root under one of the two orders that stands at three places of the run at least; where
such a word meets its copy, longest common extensions to both sides give the run.

Words that can't be in a run are cut out before, exactly: within a segment, a run's words stand there
REPEATS times or more, with an equal word within a REPEATS-th of the segment. Cutting is repeated while
it takes much. Segments of many documents are grouped together, parted by the least symbol.

Null and empty texts, and texts without words, have no run. Ties of the longest run go to the least start,
then period. Repeated rows give equal rows. A very long text is handled whole, in one task. An empty
table gives none. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, ship, table, text_of

LEAST, REPEATS = 6, 4
#: Words of the documents whose segments are grouped together; cutting stops when it takes less than this share.
BLOCK, WORTH = 400_000, 0.05
#: Two primes and bases of the hashes by which extensions are searched; runs found are then compared word by word.
PRIMES, BASES = (2**31 - 1, 2**31 - 19), (1_000_003, 7_368_787)


def lyndon(word: list[int]) -> list[int]:
    """End of the longest Lyndon word that starts at each position; the least value parts the texts, and its positions get no end of use."""
    n, rank = len(word), {x: k for k, x in enumerate(sorted(set(word)))}
    end, left, right = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 2))
    group, below, above = [rank[x] for x in word], list(range(-1, len(rank) - 1)), [*range(1, len(rank)), -1]
    members = [[] for _ in rank]
    for i, g in enumerate(group):
        members[g].append(i)
    at = len(rank) - 1
    while at > 0:
        hits = {}
        for i in members[at]:
            if group[i] == at:  # else it moved to a greater group
                a, b = left[i], right[i]
                if b < n:
                    left[b] = a
                if a >= 0:
                    right[a] = b
                    hits[a] = hits.get(a, 0) + 1
                    end[a] = end[i]
        members[at] = None
        moved = {}
        for i, copies in hits.items():
            moved.setdefault((group[i], copies), []).append(i)
        # right above the old group: first those of one copy, then of two and so on; what moved up earlier stays above them
        for g, copies in sorted(moved, key=lambda key: -key[1]):
            new, upper = len(members), above[g]
            for i in moved[g, copies]:
                group[i] = new
            members.append(moved[g, copies])
            below.append(g)
            above.append(upper)
            above[g] = new
            below[upper] = new
        at = below[at]
    return end


class Prints:
    """Hashes of all stretches of an array."""

    def __init__(self, values: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in zip(PRIMES, BASES, strict=True):
            power = np.ones(1, np.uint64)
            while len(power) <= len(values):
                power = np.r_[power, power * np.uint64(int(power[-1]) * base % prime) % np.uint64(prime)]
            terms = (values.astype(np.uint64) + np.uint64(1)) * power[: len(values)] % np.uint64(prime)
            self.sums.append(np.r_[np.uint64(0), np.cumsum(terms) % np.uint64(prime)])
            self.powers.append(power)

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at i and j, i <= j, look alike."""
        out = np.ones(len(i), bool)
        for prime, sums, powers in zip(PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            a, b = (sums[x + length] + p - sums[x] for x in (i, j))
            out &= a % p * powers[j - i] % p == b % p
        return out

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The longest common extension of i and j, up to most, to the right of them or, with back, to the left."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            yes = self.same(i - mid, j - mid, mid) if back else self.same(i, j, mid)
            low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
        return low


def segments(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that can be in a run, and the number of the segment of each, rising. text: the number of each word's text."""
    at, part = np.arange(len(word)), text
    while len(at):
        _, part, size = np.unique(part, return_inverse=True, return_counts=True)
        kind = part * (int(word.max()) + 1) + word[at]
        order = np.argsort(kind, kind="stable")
        same = kind[order[1:]] == kind[order[:-1]]
        gap = np.where(same, np.diff(at[order]), len(word) + 1)
        near, number = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        near[order] = np.minimum(np.r_[gap, len(word) + 1], np.r_[len(word) + 1, gap])
        first = np.flatnonzero(np.r_[True, ~same])
        number[order] = np.repeat(np.diff(np.r_[first, len(at)]), np.diff(np.r_[first, len(at)]))
        keep = (number >= REPEATS) & (near <= size[part] // REPEATS) & (size[part] >= LEAST)
        worth = len(at) - np.count_nonzero(keep) > WORTH * len(at)
        at, part = at[keep], part[keep]
        part = np.cumsum(np.r_[0, (np.diff(at) != 1) | (np.diff(part) != 0)]) if len(at) else part
        if not worth:
            break
    return at, part


def find(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. text: the number of each word's text, rising; runs do not cross texts."""
    at, part = segments(word, text)
    if not len(at):
        return np.empty((0, 3), np.int64)
    part = part - part[0]
    place = np.arange(len(at)) + part + 1  # a parting symbol before each segment and at the end
    flat = np.zeros(len(at) + int(part[-1]) + 2, np.int64)
    flat[place] = word[at] + 1
    origin = np.zeros(len(flat), np.int64)
    origin[place] = at
    edge = np.flatnonzero(flat == 0)
    low = edge[np.searchsorted(edge, place) - 1] + 1
    high = edge[np.searchsorted(edge, place)]
    prints, most = Prints(flat), int(flat.max())
    found = []
    for values in (flat, np.where(flat > 0, most + 1 - flat, 0)):
        q = np.array(lyndon(values.tolist()), np.int64)[place] - place
        some = np.flatnonzero(place + REPEATS * q - q < high)  # the root, met early in its run, has two copies and more behind it
        some = some[prints.same(place[some], place[some] + q[some], 2 * q[some])]
        found.append(np.stack([place[some], q[some], low[some], high[some]], 1))
    i, q, lo, hi = np.concatenate(found).T
    start = i - prints.common(i, i + q, i - lo, back=True)
    stop = i + q + prints.common(i, i + q, hi - i - q)
    rows, first, each = np.unique(np.stack([start, stop, q], 1), axis=0, return_index=True, return_inverse=True)
    out = set()
    for k, (s, e, p) in enumerate(rows.tolist()):
        x, y = int(lo[first[k]]), int(hi[first[k]])
        if _is_run(flat, s, e, p, x, y):
            out.add((s, e, p))
        else:  # stretches with one hash: each root is extended word by word
            out |= {_extended(flat, z, p, x, y) for z in i[each.ravel() == k].tolist()}
    out = {(int(origin[s]), e - s, p) for s, e, p in out if e - s >= max(LEAST, REPEATS * p)}
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _is_run(flat: np.ndarray, s: int, e: int, q: int, lo: int, hi: int) -> bool:
    whole = np.array_equal(flat[s : e - q], flat[s + q : e])
    return whole and (s == lo or flat[s - 1] != flat[s - 1 + q]) and (e == hi or flat[e] != flat[e - q])


def _extended(flat: np.ndarray, i: int, q: int, lo: int, hi: int) -> tuple[int, int, int]:
    equal = flat[lo : hi - q] == flat[lo + q : hi]
    left, right = equal[: i - lo][::-1], equal[i - lo :]
    count = lambda x: len(x) if x.all() else int(np.argmin(x))
    return i - count(left), i + q + count(right), q


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start and length in words, period) by start, then period, and collapsed: the words with one period of each run, joined by spaces."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(w) for w in texts], np.int64)
        numbers = []
        for w in texts:
            known = {}
            numbers += [known.setdefault(x, len(known)) for x in w]
        runs = find(np.array(numbers, np.int64), np.repeat(np.arange(len(texts)), sizes))
        ends = np.cumsum(sizes)
        cut = np.searchsorted(runs[:, 0], np.r_[0, ends])
        collapsed = []
        for w, first, i, j in zip(texts, (ends - sizes).tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            runs[i:j, 0] -= first
            if i < j:
                drop = np.zeros(len(w) + 1, np.int64)
                np.add.at(drop, runs[i:j, 0] + runs[i:j, 2], 1)
                np.add.at(drop, runs[i:j, 0] + runs[i:j, 1], -1)
                w = [w[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
            collapsed.append(b" ".join(w))
        of_run = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), of_run), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held = [], [], 0
            for k, t in enumerate(b.column(1)):
                ids.append(b.column(0).slice(k, 1))
                texts.append(t.as_py().encode("utf-8", "surrogatepass").split())
                held += len(texts[-1])
                if held > BLOCK:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield block(ids, texts)

    kinds = f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", text_of().alias("__text")).mapInArrow(run, kinds)


def repeated(docs: DataFrame) -> DataFrame:
    """docs, where a tenth of the texts, by the checksum h of doc_id, become periodic from a word on: the query's planted cases."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", f"[{WHITE}]+"), "")

    def planted(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
        return F.when(n > 0, F.array_join(places, " ")).otherwise("")

    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("__w"))
    return rows.select("doc_id", F.when(F.col("__w").isNull(), F.col("text")).otherwise(planted(F.col("__w"))).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(repeated(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
