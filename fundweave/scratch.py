"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may lack it."""
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir"):
        return base.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/fundweave-scratch"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df once and read it back: cuts the lineage, survives lost executors. drop() removes the table."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got._scratch_path = path
    return got


def reads(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which reads a table of materialise(), so that drop(df) removes it."""
    df._scratch_path = table._scratch_path
    return df


def drop(*tables: DataFrame | None) -> None:
    """Remove tables of materialise() that nothing will read again; other frames are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
