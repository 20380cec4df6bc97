"""Statement files of a case, from bytes to drafts: extract, classify, normalise, reconcile, status.

A batch of files goes through as one set of Spark jobs. A material is known by the SHA-256 of its bytes.
Every step can be repeated: chunk files are replaced as a whole, a batch's drafts are committed once (its
number is part of the commit), materials are replaced by id. Errors are rows, so no file's list of them
must fit one record. Files over the size limit, broken files and refused rows leave the others alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, parse
from ..operators import reconcile, running
from ..scratch import drop, materialise
from . import files, repository

#: Fields of a record that a row of cells gives.
ROW_FIELDS = ("transaction_time", "serial_number", "payer_account", "payer_name", "payer_institution", "payer_bank", "payee_account", "payee_name", "payee_institution", "payee_bank", "debit_credit", "currency", "amount", "balance_after", "channel", "summary", "region", "transaction_type")
#: What a record of a row is unless it says otherwise.
DEFAULTS = {"record_type": "bank_transfer", "event_status": "success"}
LOCATED = ("archive_member_path", "page_number", "sheet_name", "table_number", "paragraph_number", "row_number", "region")
NEEDS_REVIEW = "needs_manual_review"
#: Extracted rows are kept compressed, in files of so many rows, since a compressed file is read by one task.
EXTRACTED = {"compression": "gzip", "maxRecordsPerFile": 200_000}


def _plain(path: str) -> str:
    """A path for load() whose name holds no pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def materials_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, material_id, file_name): one row for each content, with the least path of those that hold it."""
    found = spark.read.format("binaryFile").load([_plain(p) for p in paths])
    small = found.where(F.col("length") <= files.MAX_BYTES).select("path", F.sha2("content", 256).alias("material_id"))
    large = found.where(F.col("length") > files.MAX_BYTES).select("path", F.sha2(F.encode("path", "utf-8"), 256).alias("material_id"))  # refused, whatever it holds
    first = small.unionByName(large).groupBy("material_id").agg(F.min("path").alias("path"))
    return first.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def classified(chunks: DataFrame) -> DataFrame:
    """chunks with classification."""
    return chunks.withColumn("classification", classify.classify(F.col("text"), F.col("suffix"), F.col("requires_vision")))


def records_of(chunks: DataFrame) -> DataFrame:
    """Rows of cells as records: material_id, chunk_index, source, the record's fields and reject_reason."""
    where = F.struct(F.col("material_id").alias("source_file_id"), *LOCATED)
    rows = chunks.where("row_data IS NOT NULL").select("material_id", "chunk_index", where.alias("source"), "row_data")
    given = [F.lit(v).alias(k) for k, v in DEFAULTS.items()]
    return parse.normalise_rows(rows).select("material_id", "chunk_index", "source", *ROW_FIELDS, *given, "review_status", "provenance", "parser_name", "reject_reason")


def parse_materials(spark: SparkSession, paths: list[str], folder: str, batch: tuple[str, int]) -> DataFrame:
    """Take the files at paths into the case's folder and give their materials with status and counts.

    batch: (stream, number). A number that is not above the stream's last one leaves the drafts as they are.
    paths is bounded by whoever deals the batches (the stream's files_per_batch).
    """
    of_batch = f"{folder}/extracted/{batch[0]}-{batch[1]:020d}"
    materials = materialise(materials_of(spark, paths), "ingest-materials")
    repository.update_materials(materials.select("material_id", "file_name", F.lit("parsing").alias("status"), F.col("material_id").alias("sha256")), folder)
    read = files.read_chunks(spark, [_plain(p) for p in paths])
    # ids rise within a task, and a file or an archive's member is read by one task
    numbered = read.withColumn("chunk_index", F.monotonically_increasing_id())
    chunks = materialise(numbered.join(materials.select("path", "material_id"), "path"), "ingest-chunks", "zstd")
    drop(read)
    chunks.write.mode("overwrite").options(**EXTRACTED).json(f"{of_batch}/raw")
    classified(chunks).write.mode("overwrite").options(**EXTRACTED).json(f"{of_batch}/classified")
    records = materialise(records_of(chunks.where("error IS NULL")), "ingest-records")
    at = ("material_id", "chunk_index", "source.sheet_name", "source.row_number", "source.page_number")
    refused = records.where("reject_reason IS NOT NULL").select(*at, F.col("reject_reason").alias("error"), F.lit(NEEDS_REVIEW).alias("status"))
    broken = chunks.where("error IS NOT NULL").select("material_id", "chunk_index", "sheet_name", "row_number", "page_number", "error", F.lit("failed").alias("status"))
    errors = materialise(refused.unionByName(broken), "ingest-errors")
    errors.write.mode("overwrite").options(**EXTRACTED).json(f"{of_batch}/errors")
    accepted = records.where("reject_reason IS NULL").drop("reject_reason")

    count = lambda d, name: d.groupBy("material_id").agg(F.count("*").alias(name))
    counts = materials.drop("path").join(count(chunks.where("error IS NULL"), "chunk_count"), "material_id", "left").join(count(accepted, "draft_count"), "material_id", "left").join(count(errors, "error_count"), "material_id", "left")
    counts = counts.fillna(0, ["chunk_count", "draft_count", "error_count"])
    done = counts.withColumns({"status": reconcile.material_status(F.col("error_count"), F.col("draft_count"), F.lit(False)), "sha256": F.col("material_id")})
    done = materialise(done, "ingest-done")
    drop(materials, chunks, errors)
    # a source that was read without errors is replaced; one that was read in part keeps its earlier records
    sources = done.where("draft_count > 0").select(F.col("material_id").alias("source_file_id"), (F.col("error_count") == 0).alias("replace_missing"))
    placed = running.places(accepted, [F.asc("material_id"), F.asc("source.archive_member_path"), F.asc("chunk_index")], "ingest-placed")
    drop(records)
    repository.reconcile_sources(placed.withColumn("seq", F.col("place")).drop("place", "material_id", "chunk_index"), folder, sources, batch)
    repository.update_materials(done, folder)
    drop(placed)
    return done
