"""Merkle manifest of a dataset by concatenated-level strings, in DataFrame operations.

A row is a leaf, the digest of its columns. Leaves are numbered for each lang by doc_id. An aligned
block of ARITY**levels leaves keeps each of its levels as one hex string: every 512 characters of it (8
digests; the last run may be shorter) are a parent's input, and what flanks a digest within its run are
its siblings. The tops of a lang's blocks are the leaves of the next round, so there are as many rounds as
the logarithm of the rows to the base ARITY**levels, and no task holds more than a block. The subroots
of the langs, in order, are the leaves of one more such tree, whose top is the root.

Nulls in any column are written "-", so they differ from empty texts; null lang is a lang of its own, the first.
Leaves of a lang ascend by doc_id, nulls first; rows of one doc_id by digest; rows alike in all columns are leaves
of their own. A very long text is hashed whole, its digest is as long as any other. An empty table
gives an empty manifest. Columns other than those of COLUMNS are not read, whatever their names.
"""

from __future__ import annotations

import string
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import places
from .common import drop, materialise, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, DIGITS, LEVELS = 8, 64, 3
RUN = ARITY * DIGITS
UPPER, SMALL = string.ascii_uppercase, string.ascii_lowercase


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def framed(value: Column) -> Column:
    """UTF-8 byte count, colon, value; a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, g (the lang as a key that is not null), leaf, and changed: the leaf after tampering, null where there was none."""
    col = {c: F.col(c) for c in COLUMNS}
    lowered = {**col, "text": F.translate("text", UPPER, SMALL)}
    leaf = lambda cols: digest(*(framed(cols[c]) for c in COLUMNS))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select("doc_id", F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit(" "), "lang")).alias("g"), leaf(col).alias("leaf"), F.when(tampered, leaf(lowered)).alias("changed"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with place, from 0 within their g, and n, the rows of their g. A g of any size is spread over range partitions."""
    placed = places(rows, [F.asc("g"), *order], name)
    # written first, so that its size is known: joined by broadcast while it is small, and the rows are not dealt by g
    groups = materialise(placed.groupBy("g").agg(F.min("place").alias("first"), F.count("*").alias("n")), f"{name}-groups")
    return placed.join(groups, "g").withColumn("place", F.col("place") - F.col("first")).drop("first")


def _position(level: int) -> Column:
    """Place within its run of the node that stands over leaf p at a level."""
    return F.shiftright("p", 3 * level).bitwiseAND(F.lit(ARITY - 1)).cast("int")


def _siblings(level: int) -> Column:
    """What stands left and right of the node in its run; null above the lang's top."""
    run = F.get(f"runs{level}", F.shiftright("p", 3 * (level + 1)))
    at = _position(level) * DIGITS
    return F.when(F.col("n") > ARITY**level, F.struct(F.substr(run, F.lit(1), at).alias("left"), F.substr(run, at + DIGITS + 1, F.lit(RUN)).alias("right")))


def _run(level: Column, number: Column) -> Column:
    return F.substr(level, number * RUN + 1, F.lit(RUN))


def climb(nodes: DataFrame, item: list[str], levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes: g, n, place (from 0), digest and the columns item. Gives g, item, digest and siblings (left, right from below to the top of g), and (g, top)."""
    wide = ARITY**levels
    member = F.struct((F.col("place") % wide).cast("int").alias("p"), "digest", *item)
    blocks = nodes.groupBy("g", "n", F.floor(F.col("place") / wide).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("items"))  # at most `wide` members
    blocks = blocks.withColumn("level0", F.array_join("items.digest", ""))
    for k in range(levels):
        last = F.ceil(F.length(f"level{k}") / RUN).cast("int") - 1
        level = F.col(f"level{k}")
        blocks = blocks.withColumn(f"runs{k}", F.transform(F.sequence(F.lit(0), last), partial(_run, level)))
        parents = F.array_join(F.transform(f"runs{k}", lambda run: F.sha2(run, 256)), "")
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("n") > ARITY**k, parents).otherwise(level))
    runs = [f"runs{k}" for k in range(levels)]
    blocks = materialise(blocks.select("g", "n", "block", "items", *runs, F.col(f"level{levels}").alias("top")), "merkle-blocks")
    tops = blocks.where(F.col("n") <= wide).select("g", "top")
    above = blocks.where(F.col("n") > wide).select("g", F.ceil(F.col("n") / wide).alias("n"), F.col("block").alias("place"), F.col("top").alias("digest"), "block")
    own = F.array_compact(F.array(*(_siblings(k) for k in range(levels))))
    if above.isEmpty():
        rows = blocks.select("g", "n", *runs, F.inline("items"))
        return rows.select("g", *item, "digest", own.alias("siblings")), tops
    upper, more = climb(above, ["block"], levels)
    met = blocks.join(upper.select("g", "block", F.col("siblings").alias("upper")), ["g", "block"], "left")
    rows = met.select("g", "n", "upper", *runs, F.inline("items"))
    return rows.select("g", *item, "digest", F.when(F.col("upper").isNull(), own).otherwise(F.concat(own, "upper")).alias("siblings")), tops.unionByName(more)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, changed, subroot, root and siblings (from the leaf through the subroot to the root) of every row."""
    hashed = materialise(leaves(docs).withColumn("__r", F.rand(7)), "merkle-hashed")  # the sort reads its rows twice
    nodes = numbered(hashed, [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("__r")], "merkle-leaves").withColumnRenamed("leaf", "digest")
    drop(hashed)
    rows, tops = climb(nodes, ["doc_id", "changed"], levels)
    tops = materialise(tops, "merkle-subroots")
    langs = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("top").alias("digest")), [F.asc("lang")], "merkle-langs")
    over, root = climb(langs, ["lang"], levels)
    heads = over.join(root, "g").select(F.col("lang").alias("g"), F.col("digest").alias("subroot"), F.col("siblings").alias("over"), F.col("top").alias("root"))
    heads = materialise(heads, "merkle-heads")  # one row for each lang
    drop(tops)
    return rows.join(heads, "g").select("doc_id", F.col("digest").alias("leaf"), "changed", "subroot", "root", F.concat("siblings", "over").alias("siblings"))


def proof(siblings: str = "siblings") -> Column:
    """Digest of all siblings from left to right, level by level."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, siblings: str = "siblings") -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(siblings, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents")).withColumn("folded_root", fold(F.coalesce("changed", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql(depth: int = 8) -> str:
    """The same with a window and a self-join for each level; depth: levels of a tree at most."""

    def tree(name: str, source: str) -> str:
        """name0 .. name{depth}: nodes (g, n, pos, h) of each level."""
        out = [f"{name}0 AS ({source})"]
        for k in range(1, depth + 1):
            # the group of a level of one node stays as it is
            out.append(f"{name}{k} AS (SELECT g, (n + {ARITY - 1}) // {ARITY} AS n, pos // {ARITY} AS pos, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k - 1} GROUP BY g, n, pos // {ARITY})")
        return ",\n".join(out)

    def path(name: str, key: str, rows: str) -> str:
        """Siblings of each row of rows (key, g, pos) at each level."""
        parts = []
        for k in range(depth):
            parts.append(
                f"SELECT r.{key}, {k} AS level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < r.pos // {ARITY**k}), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > r.pos // {ARITY**k}), '') AS r "
                f"FROM {rows} r JOIN {name}{k} s ON s.g = r.g AND s.pos // {ARITY} = r.pos // {ARITY ** (k + 1)} WHERE s.n > 1 GROUP BY r.{key}, r.g, r.pos"
            )
        return "\nUNION ALL ".join(parts)

    frame = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(frame(text if c == "text" else c) for c in COLUMNS) + ")"
    lowered = f"translate(text, '{UPPER}', '{SMALL}')"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))), lambda c, b: {bits}))"
    return f"""
WITH RECURSIVE leafs AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE ' ' || lang END AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lowered)} END AS changed FROM documents),
nodes AS MATERIALIZED (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leafs),
{tree('t', 'SELECT g, n, pos, leaf AS h FROM nodes')},
langs AS MATERIALIZED (SELECT g AS lang, 0 AS g, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS pos, h FROM t{depth}),
{tree('u', 'SELECT g, n, pos, h FROM langs')},
own AS MATERIALIZED ({path('t', 'id', 'nodes')}),
over_ AS MATERIALIZED ({path('u', 'lang', 'langs')}),
steps AS (SELECT id, level, l, r FROM own UNION ALL SELECT id, {depth} + level, l, r FROM nodes JOIN over_ ON over_.lang = nodes.g),
way AS (SELECT id, list({{'l': l, 'r': r}} ORDER BY level) AS s, string_agg(l || r, '' ORDER BY level) AS joined FROM steps GROUP BY id),
fold AS (SELECT id, 0 AS k, coalesce(changed, leaf) AS h, s FROM nodes LEFT JOIN way USING (id)
 UNION ALL SELECT id, k + 1, sha256(s[k + 1].l || h || s[k + 1].r), s FROM fold WHERE k < len(s)),
folded AS (SELECT id, arg_max(h, k) AS h FROM fold GROUP BY id)
SELECT doc_id, leaf, langs.h AS subroot, top.h AS root, sha256(coalesce(joined, '')) AS proof_sha256, folded.h AS folded_root, folded.h = top.h AS verified
FROM nodes JOIN langs ON langs.lang = nodes.g CROSS JOIN u{depth} top JOIN folded USING (id) LEFT JOIN way USING (id)
"""
