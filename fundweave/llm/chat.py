"""Chat formatting after collapsing cumulative snapshots.

A logged conversation that is a turn-by-turn prefix of a longer one, or equal to one with a smaller
conv_id, is a snapshot of it. Rolling hashes tell: the hash of the first k turns is the SHA-256 of the
hash of the first k - 1 with role and text. Anti-joins of whole hashes against proper-prefix hashes
retain the maximal conversations, which are then rendered.

Turns are ordered by turn, role, text (nulls first), and exact repeats of a row count once. A null
role or text differs from an empty one in the hash and is rendered as empty. Rows with a null conv_id
belong to no conversation and are left out. A conversation is rendered as one value, so its turns must
fit one row. The hashes of all prefixes are made distinct before the join, so that a first turn that
very many conversations share is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

START, END = "<|im_start|>", "<|im_end|>"


def _turn_key(t: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(part(t["role"]), part(t["text"]))


def assemble(turns: DataFrame) -> DataFrame:
    """conv_id, turns (sorted) and prefix_hashes."""
    got = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(a: Column, t: Column) -> Column:
        h = F.sha2(F.concat(a["last"], _turn_key(t)), 256)
        return F.struct(h.alias("last"), F.array_append(a["all"], h).alias("all"))

    return got.select("conv_id", "turns", F.aggregate("turns", start, step, lambda a: a["all"]).alias("prefix_hashes"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, turns, n_copies (equal conversations, itself included)."""
    convs = materialise(assemble(turns), "chat")
    convs = convs.withColumn("whole", F.element_at("prefix_hashes", -1))
    proper = convs.select(F.explode(F.slice("prefix_hashes", 1, F.size("prefix_hashes") - 1)).alias("whole")).distinct()
    kept = convs.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")).join(proper, "whole", "left_anti")
    return convs.select("conv_id", "turns").join(kept.select("conv_id", "n_copies"), "conv_id")


def render(turns: Column) -> Column:
    empty = F.lit("")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), F.coalesce(t["role"], empty), F.lit("\n"), F.coalesce(t["text"], empty), F.lit(f"{END}\n"))), "")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations")).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("rendered"))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') AS k FROM t),
p AS (SELECT conv_id, row_number() OVER o AS n, count(*) OVER (PARTITION BY conv_id) AS m, string_agg(k, '') OVER (o ROWS UNBOUNDED PRECEDING) AS prefix,
 '{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10) AS shown FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
w AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE n = m GROUP BY prefix),
kept AS (SELECT * FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE n < m))
SELECT kept.conv_id, CAST(any_value(m) AS BIGINT) AS n_turns, CAST(any_value(n_copies) AS BIGINT) AS n_copies, string_agg(shown, '' ORDER BY n) AS rendered FROM kept JOIN p USING (conv_id) GROUP BY kept.conv_id
"""
