"""Exact duplicates and same-serial conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_identifier


def exact_key() -> Column:
    serial = clean_identifier(F.col("serial_number"))
    return F.concat_ws(
        "|", F.when(serial != "", "serial").otherwise("fallback"), serial, F.date_format("transaction_time", "yyyy-MM-dd'T'HH:mm:ss"),
        F.coalesce("payer_account", F.lit("")), F.coalesce("payee_account", F.lit("")), F.upper(F.coalesce("currency", F.lit(""))), F.col("amount").cast("decimal(18,2)").cast("string"),
    )


def family() -> Column:
    """What rows that can be duplicates or in conflict have in common: their serial, without one the exact key."""
    serial = clean_identifier(F.col("serial_number"))
    return F.when(serial != "", serial).otherwise(exact_key())


def mark_together(df: DataFrame, dealt: list[str]) -> DataFrame:
    """mark() where each family lies in one partition already, dealt by the columns named: nothing is shuffled. A family is one window, so none should be very large."""
    at = Window.partitionBy(*dealt, "__family").orderBy("__key")
    same, whole = at.rangeBetween(Window.currentRow, Window.currentRow), at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = df.drop("duplicate_group", "conflict_status").withColumns({"__family": family(), "__key": exact_key()})
    counted = kept.withColumns({"__n": F.count("*").over(same), "__least": F.min("__key").over(whole), "__most": F.max("__key").over(whole)})
    group = F.when(F.col("__n") > 1, F.concat(F.lit("DUP-"), F.upper(F.substring(F.sha2("__key", 256), 1, 12))))
    conflict = F.when(F.col("__least") != F.col("__most"), F.lit("same_serial_conflicting_fields"))
    return counted.withColumns({"duplicate_group": group, "conflict_status": conflict}).drop("__family", "__key", "__n", "__least", "__most")


def mark(df: DataFrame) -> DataFrame:
    """df with duplicate_group and conflict_status.

    Counts come from two aggregations (exact key, then serial) that are joined back, so that a key with
    very many rows is pre-aggregated and its join side can be split, unlike a window partition.
    """
    keyed = df.drop("duplicate_group", "conflict_status").withColumns({"__serial": clean_identifier(F.col("serial_number")), "__key": exact_key()})
    exact = keyed.groupBy("__serial", "__key").agg(F.count("*").alias("__n"))
    # rows without a serial can be duplicates but not in conflict; they stay out of the join, where "" would be one hot key
    named, blank = exact.where(F.col("__serial") != ""), exact.where((F.col("__serial") == "") & (F.col("__n") > 1))
    serials = named.groupBy("__serial").agg(F.count("*").alias("__kinds"))
    marks = named.join(serials, "__serial").where((F.col("__n") > 1) | (F.col("__kinds") > 1))
    marks = marks.unionByName(blank.withColumn("__kinds", F.lit(1).cast("long")))
    group = F.when(F.col("__n") > 1, F.concat(F.lit("DUP-"), F.upper(F.substring(F.sha2("__key", 256), 1, 12))))
    conflict = F.when(F.col("__kinds") > 1, F.lit("same_serial_conflicting_fields"))
    marks = marks.select("__key", group.alias("duplicate_group"), conflict.alias("conflict_status"))
    return keyed.join(marks, "__key", "left").drop("__serial", "__key")


def canonical(df: DataFrame) -> DataFrame:
    """The first row, by seq, of each duplicate group; rows without a group all stay."""
    first = df.where("duplicate_group is not null").groupBy("duplicate_group").agg(F.min("seq").alias("__first"))
    kept = df.where("duplicate_group is not null").join(first, "duplicate_group").where(F.col("seq") == F.col("__first")).select(*df.columns)
    return df.where("duplicate_group is null").unionByName(kept)  # most rows have no group and are not shuffled


def histogram(df: DataFrame) -> DataFrame:
    """Rows, duplicate groups, canonical rows and conflicting rows in one line."""
    groups = df.groupBy("duplicate_group").agg(F.count("*").alias("c"), F.count("conflict_status").alias("k"))
    known = F.col("duplicate_group").isNotNull()
    return groups.agg(
        F.sum("c").alias("n_rows"), F.count_if(known).alias("n_groups"),
        (F.sum("c") - F.coalesce(F.sum(F.when(known, F.col("c") - 1)), F.lit(0))).alias("n_canonical"), F.sum("k").alias("n_conflict_rows"),
    )
