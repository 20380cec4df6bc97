"""What the training-data operators share: reading tables, scratch tables, shipping the package."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, materialise, scratch_dir  # noqa: F401

PACKAGE = Path(__file__).resolve().parents[1]
#: ASCII white space of the contracts: [\x20\x09-\x0D].
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER_TO_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LOWER = bytes.maketrans(*_UPPER_TO_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where PYTHONPATH does not already show it."""
    sc = spark.sparkContext
    if getattr(sc, "_fundweave_shipped", False):
        return
    shown = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and (Path(p) / PACKAGE.name).is_dir()]
    if not shown:
        with tempfile.TemporaryDirectory() as tmp:
            kept = shutil.copytree(PACKAGE, f"{tmp}/zip/{PACKAGE.name}", ignore=shutil.ignore_patterns("__pycache__"))
            sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{PACKAGE.name}", "zip", Path(kept).parent))
    sc._fundweave_shipped = True


def trim() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def words_of(data: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return data.encode("utf-8", "surrogatepass").translate(LOWER).split()
