"""Streaming ingest: transactions, of which exact repeats within the watermark are dropped, and the statement files of a case."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import exact_key
from ..sources import commits, ingest

BINARY_DDL = "path string, modificationTime timestamp, length long, content binary"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def distinct_records(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows whose exact key has not been seen within `late` of event time."""
    timed = stream.withColumns({"event_time": F.col("transaction_time").cast("timestamp"), "exact_key": exact_key()})
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["exact_key"])


def hourly_totals(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    timed = stream.withColumn("event_time", F.col("transaction_time").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", "1 hour"), "payer_account").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def write(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_materials(spark: SparkSession, path: str, folder: str, checkpoint: str, files_per_batch: int = 1000):
    """Take statement files that arrive under path into a case's folder, batch by batch, each once (ingest.parse_materials).

    The stream carries paths only; a batch's files are read inside its own jobs. The stream's name lies beside its
    checkpoint, so that a new checkpoint, whose batches count from 0 again, is another stream.
    """
    commits.claim(spark, f"{checkpoint.rstrip('/')}-stream", uuid.uuid4().hex.encode())
    name = commits.read(spark, f"{checkpoint.rstrip('/')}-stream").decode()

    def run(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.collect()]  # files_per_batch at most
        if paths:
            ingest.parse_materials(spark, paths, folder, (name, number))

    found = spark.readStream.format("binaryFile").schema(BINARY_DDL).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path).select("path")
    return found.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
