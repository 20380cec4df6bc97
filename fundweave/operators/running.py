"""Places and running sums over range partitions: a key with very many rows is never one window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise, reads


def ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df in a total order, written once, with the range partition __part of each row and its number __row there, from 0. drop() removes what was written."""
    at = F.monotonically_increasing_id()  # partition * 2^33 + row
    table = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), name)
    return reads(table.withColumns({"__part": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit(2**33 - 1))}).drop("__at"), table)


def places(df: DataFrame, order: list[Column], name: str = "places") -> DataFrame:
    """df with place, from 1 on, in a total order. The driver sees one number for each range partition. drop() removes what was written."""
    rows = ranged(df, order, name)
    bases, done = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("__part").count().collect())):
        bases.append((part, done))
        done += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(bases, "__part long, __base long"))
    return reads(rows.join(offsets, "__part").withColumn("place", F.col("__base") + F.col("__row") + 1).drop("__part", "__row", "__base"), rows)


def running_sum(df: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value so far over each key (not null), and {name}_last, whether the row is its key's last.

    Sums run over what a range partition holds of a key; those parts' totals, at most one for each
    partition and key, run over the key.
    """
    rows = ranged(df, [F.asc(key), *order], f"running-{name}")
    over = Window.partitionBy(key).orderBy("__part")
    parts = rows.groupBy(key, "__part").agg(F.sum(value).alias("__s"), F.max("__row").alias("__end"))
    parts = parts.select(key, "__part", (F.sum("__s").over(over) - F.col("__s")).alias("__before"), F.when(F.lead("__part").over(over).isNull(), F.col("__end")).alias("__end"))
    within = Window.partitionBy(key, "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn(name, F.sum(value).over(within)).join(parts, [key, "__part"])
    return joined.withColumns({name: F.col(name) + F.col("__before"), f"{name}_last": F.col("__row").eqNullSafe(F.col("__end"))}).drop("__part", "__row", "__before", "__end")
