"""Large CSV files in byte ranges: quoted cells may hold line ends, so a range can begin inside a cell.

Spark cuts a file at line ends into ranges. Whether a line begins inside a quoted cell depends on all
lines before it, but only through one bit: each line maps "outside" and "inside" to the state at its
end, and such maps combine. First each range gives its combined map and how many records begin in it, for
both states at its start: a few numbers for each range, from which the driver has every range's start
state and first record number. Then each range is read again and deals its lines to records. Records of one line,
nearly all, are parsed where they are; the lines of longer ones meet by record number. No range is
held whole, and no line order is lost.

Quotes count as in csv.reader: only at the start of a cell, doubled ones inside stand for one, and in
a cell that began without a quote they are plain characters. The first record of a file is its header; blanks pad short rows.
A record's number counts from 1 with the header; blank lines count, but give no row. Empty files give no rows. A cell that only
the file's end closes goes without the file's last line end.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise

#: Characters of a record at most, which bounds what a quote that never closes can gather; rows of an Arrow batch.
MOST_CHARS, BATCH = 1 << 27, 4096
#: Rows that a task has as Python objects at once, about; characters after which it gives what it has.
PIECE, CHARS = 256, 1 << 20


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line (without its line end) ends inside a quoted cell."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:  # at the start of a cell
            if at < n and line[at] == '"':
                inside, at = True, at + 1
            else:
                comma = line.find(",", at)
                if comma < 0:
                    return False
                at = comma + 1
                continue
        quote = line.find('"', at)
        if quote < 0:
            return True
        if quote + 1 < n and line[quote + 1] == '"':
            at = quote + 2
            continue
        inside = False  # the cell is closed; what follows up to the comma is plain
        comma = line.find(",", quote + 1)
        if comma < 0:
            return False
        at = comma + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): lines by \\n alone, in the order of each range; start: the range's first byte."""
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of PIECE rows: rows of texts take several times their size as Python objects."""
    return (b.slice(k, PIECE) for b in batches for k in range(0, b.num_rows, PIECE))


def _ranges(batches: Iterator[pa.RecordBatch]):
    """The lines of each (file, start) in turn."""
    rows = (row for b in _pieces(batches) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (file, start), own in groupby(rows, key=lambda r: (r[0], r[1])):
        lines = (r[2] for r in own)
        if start == 0:
            lines = (line.removeprefix("\ufeff") if k == 0 else line for k, line in enumerate(lines))
        yield file, start, lines


def summaries(lines: DataFrame) -> DataFrame:
    """For each range: the state at its end and the records that begin in it, if it starts outside and if it starts inside a quoted cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, own in _ranges(batches):
            state, begun = [False, True], [0, 0]
            for line in own:
                for k in (0, 1):
                    begun[k] += not state[k]
                if state[0] == state[1]:
                    state = [inside_after(line, state[0])] * 2
                else:
                    state = [inside_after(line, s) for s in state]
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "out_end": state[0], "out_n": begun[0], "in_end": state[1], "in_n": begun[1]}], _SUMMARY)

    return lines.mapInArrow(run, "file string, start long, out_end boolean, out_n long, in_end boolean, in_n long")


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("out_end", pa.bool_()), ("out_n", pa.int64()), ("in_end", pa.bool_()), ("in_n", pa.int64())])
_RECORD = pa.schema([("file", pa.string()), ("record", pa.int64()), ("start", pa.int64()), ("at", pa.int64()), ("line", pa.string()), ("cells", pa.list_(pa.string())), ("error", pa.string())])


def starts(found: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """For each range whether it starts inside a quoted cell, and the records of its file before it."""
    out, last, inside, n = {}, None, False, 0
    for r in sorted(found.collect(), key=lambda r: (r.file, r.start)):  # a few numbers for each range
        if r.file != last:
            last, inside, n = r.file, False, 0
        out[r.file, r.start] = inside, n
        inside, n = (r.in_end, n + r.in_n) if inside else (r.out_end, n + r.out_n)
    return out


def _cells(text: str) -> tuple[list[str] | None, str | None]:
    csv.field_size_limit(MOST_CHARS)
    try:
        return next(csv.reader(io.StringIO(text, newline="\n")), []), None
    except csv.Error as e:
        return None, f"Error: {e}"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, cells, error) of every record; error where it can't be read."""
    lines = _lines(spark, path)
    held = spark.sparkContext.broadcast(starts(summaries(lines)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, own in _ranges(batches):
            (inside, n), out, chars = held.value[file, start], [], 0
            for at, line in enumerate(own):
                after = inside_after(line, inside)
                n += not inside
                cells, error = _cells(line) if not inside and not after else (None, None)
                out.append({"file": file, "record": n, "start": start, "at": at, "line": None if cells is not None or error else line, "cells": cells, "error": error})
                inside, chars = after, chars + len(line)
                if len(out) >= BATCH or chars >= CHARS:
                    yield pa.RecordBatch.from_pylist(out, _RECORD)
                    out, chars = [], 0
            yield pa.RecordBatch.from_pylist(out, _RECORD)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            got = [_cells(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c for c, _ in got], pa.list_(pa.string())), pa.array([e for _, e in got], pa.string())], ["file", "record", "cells", "error"])

    dealt = lines.mapInArrow(run, "file string, record long, start long, at long, line string, cells array<string>, error string")
    whole = dealt.where("line is null").select("file", "record", "cells", "error")
    split = dealt.where("line is not null").select("file", "record", "start", "at", "line")
    long = split.groupBy("file", "record").agg(F.sum(F.length("line")).alias("n")).where(F.col("n") > MOST_CHARS).select("file", "record")
    short = split.join(long, ["file", "record"], "left_anti").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "at", "line"))).alias("l"))
    joined = short.select("file", "record", F.array_join("l.line", "\n").alias("text")).mapInArrow(parse, "file string, record long, cells array<string>, error string")
    refused = long.select("file", "record", F.lit(None).cast("array<string>").alias("cells"), F.lit("Error: a cell that does not end").alias("error"))
    return whole.unionByName(joined).unionByName(refused)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet_name, row_number, row_data and error of every row below its file's header."""
    rows = materialise(records(spark, path), "csv-records")
    heads = materialise(rows.where("record = 1").select("file", F.col("cells").alias("head")), "csv-heads")  # one row for each file
    met = rows.where("record > 1 and (error is not null or size(cells) > 0)").join(heads, "file")
    pairs = F.arrays_zip("head", F.slice("cells", 1, F.size("head")).alias("cells"))
    last = F.filter(pairs, lambda p, i: F.array_position(F.slice("head", i + 2, F.size("head")), p["head"]) == 0)  # of columns with one name the last
    entries = F.transform(last, lambda p: F.struct(p["head"].alias("key"), F.coalesce(p["cells"], F.lit("")).alias("value")))
    data = F.when(F.col("error").isNull(), F.map_from_entries(entries))
    return met.select(F.col("file").alias("path"), F.lit("Sheet1").alias("sheet_name"), F.col("record").cast("int").alias("row_number"), data.alias("row_data"), "error")
