"""Benchmark decontamination by Wu-Manber search over words.

A word is a symbol. For each pattern length a shift table over blocks of two words (one word for
one-word patterns) tells how far the search may jump; where the shift is zero the bucket of the
pattern's suffix hash lists the patterns to compare directly. Null texts have no words; an item of no
words has no window; repeated rows and items count once per row and per item_id. The windows of rows
with a null item_id count as hits, but name no item. Documents are scanned once for each block of PATTERNS_PER_BLOCK windows, so that what is
broadcast stays bounded however large the benchmark is; with more than one block the hits of each
block are merged by document row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, materialise, ship, table, text_of

WINDOW = 10
PATTERNS_PER_BLOCK = 200_000
#: Bytes that stand between words: ASCII but for 0-9 and a-z; A-Z are lower-cased.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def windows(text: str, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


class WuManber:
    """Patterns of one length over words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.m = len(next(iter(patterns)))
        self.b = min(2, self.m)
        self.jump = self.m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for p, items in patterns.items():
            for j in range(self.b, self.m + 1):
                block = p[j - 1] if self.b == 1 else p[j - 2 : j]
                self.shift[block] = min(self.shift.get(block, self.jump), self.m - j)
            self.buckets[crc32(b" ".join(p[-self.b :]))].append((p, items))

    def search(self, w: list[bytes]) -> Iterator[tuple[int, list]]:
        """(first word, items) of each occurrence, by place."""
        m, b, jump, shift, at, n = self.m, self.b, self.jump, self.shift, self.m - 1, len(w)
        while at < n:
            step = shift.get(w[at] if b == 1 else (w[at - 1], w[at]), jump)
            if step:
                at += step
                continue
            first = at - m + 1
            here = tuple(w[first : at + 1])
            for p, items in self.buckets.get(crc32(b" ".join(here[-b:])), ()):
                if p == here:
                    yield first, items
            at += 1


def build(pairs: list[tuple[object, tuple[bytes, ...]]]) -> list[WuManber]:
    by_length: dict = defaultdict(lambda: defaultdict(set))
    for item, p in pairs:
        by_length[len(p)][p].add(item)
    return [WuManber({p: sorted(i, key=str) for p, i in patterns.items()}) for _, patterns in sorted(by_length.items())]


def scan(text: str, searches: list[WuManber]) -> tuple[int, list[tuple[int, int]], set]:
    """Words, merged [first, end) word ranges that are hit, and the items with occurring windows."""
    w = words(text)
    found = [(first, first + s.m, items) for s in searches for first, items in s.search(w)]
    ranges: list[list[int]] = []
    for first, end, _ in sorted(found, key=lambda x: x[:2]):
        if ranges and first <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([first, end])
    return len(w), [tuple(r) for r in ranges], {i for x in found for i in x[2] if i is not None}


def _item_blocks(bench: DataFrame, per_block: int) -> Iterator[list]:
    """Blocks of (item_id, window), streamed to the driver one block at a time."""
    block: list = []
    for row in bench.where("text is not null").select("item_id", "text").toLocalIterator():
        for p in windows(row[1]):
            block.append((row[0], p))
            if len(block) >= per_block:
                yield block
                block = []
    if block:
        yield block


def hits(docs: DataFrame, bench: DataFrame, per_block: int = PATTERNS_PER_BLOCK) -> DataFrame:
    """Columns of docs, then __n_words, __ranges (first, end) and __items (as strings)."""
    spark = docs.sparkSession
    ship(spark)
    out = docs.select(*docs.columns)
    kind = "__n_words long, __ranges array<struct<first:int,end:int>>, __items array<string>"
    made: list[DataFrame] = []
    blocks = _item_blocks(bench, per_block)
    first = next(blocks, [])
    second = next(blocks, None)
    keyed = out if second is None else out.withColumn("__row", F.monotonically_increasing_id())
    if second is not None:
        keyed = materialise(keyed, "decontaminate")  # row numbers are fixed once written
    at = 0
    while first is not None:
        held = spark.sparkContext.broadcast(build(first))
        some = keyed if at == 0 else keyed.select("__row", "text")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema) + f", {kind}"

        def run(batches, held=held):
            struct = pa.struct([("first", pa.int32()), ("end", pa.int32())])
            for batch in batches:
                found = [scan(v.as_py() or "", held.value) for v in batch.column(batch.schema.get_field_index("text"))]
                arrays = [
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([[{"first": a, "end": b} for a, b in x[1]] for x in found], pa.list_(struct)),
                    pa.array([sorted(map(str, x[2])) for x in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "__n_words", "__ranges", "__items"])

        made.append(some.mapInArrow(run, schema))
        first, second, at = second, next(blocks, None) if second is not None else None, at + 1
    if len(made) == 1:
        return made[0]
    rest = reduce(DataFrame.unionByName, (d.select("__row", "__ranges", "__items") for d in made[1:]))
    rest = rest.where(F.size("__ranges") > 0).groupBy("__row").agg(F.flatten(F.collect_list("__ranges")).alias("__r"), F.flatten(F.collect_list("__items")).alias("__i"))
    joined = made[0].join(rest, "__row", "left")
    none = F.array().cast("array<struct<first:int,end:int>>")
    ranges = F.array_sort(F.concat("__ranges", F.coalesce("__r", none)))
    items = F.array_sort(F.array_distinct(F.concat("__items", F.coalesce("__i", F.array().cast("array<string>")))))
    return joined.select(*docs.columns, "__n_words", ranges.alias("__ranges"), items.alias("__items"))


def _hit_words(ranges):
    """Words under ranges sorted by first, which may overlap."""
    state = F.struct(F.lit(0).alias("done"), F.lit(0).cast("long").alias("n"))
    step = lambda a, r: F.struct(F.greatest(a["done"], r["end"]).alias("done"), (a["n"] + F.greatest(r["end"] - F.greatest(a["done"], r["first"]), F.lit(0))).alias("n"))
    return F.aggregate(ranges, state, step, lambda a: a["n"])


def contamination(docs: DataFrame, bench: DataFrame, per_block: int = PATTERNS_PER_BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as strings) and ranges (word places that are hit)."""
    found = hits(docs.select("doc_id", text_of().alias("text")), bench, per_block)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), _hit_words(F.col("__ranges")).alias("n_hit"), F.col("__items").alias("items"), F.col("__ranges").alias("ranges"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark window occurs."""
    renamed = docs.select(*(F.col(f"`{c}`").alias(c if c == "text" else f"c{k}") for k, c in enumerate(docs.columns)))
    clean = hits(renamed, bench).where(F.size("__ranges") == 0)
    return clean.select(*(F.col(c if c == "text" else f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.i, dw.m, p.item_id FROM dw JOIN p ON dw.m = p.m AND dw.win = p.win),
hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
