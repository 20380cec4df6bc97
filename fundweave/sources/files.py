"""Statement files to chunks: CSV, XLSX, XLS, DOCX, PDF, images and ZIP archives of these.

Files are read as binaryFile rows and cut into chunks inside tasks with the standard library; a file is
one row, so its size is bounded by MAX_BYTES (larger files are refused, not cut). An archive's members
are rows of their own. Cells are read as
text: account numbers keep their leading zeros and digits. RAR needs a library that is
not assumed and is refused with a reason.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RECORD_DDL
from ..scratch import materialise, reads
from . import ooxml, pdf, xls

MAX_BYTES, MAX_MEMBERS, MAX_UNPACKED, ROWS_PER_CHUNK = 100 << 20, 2000, 1 << 30, 8
BATCH = 1000
#: Files of rows that a task makes, on average: their bytes, and the batches in which they are read again, stay small however many there are.
FILES_A_TASK = 16
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
CHUNK_DDL = """path string, archive_member_path string, suffix string, text string, row_data map<string,string>, sheet_name string, row_number int,
paragraph_number int, table_number int, page_number int, row_evidence array<struct<row_number:int,text:string>>, requires_vision boolean, region array<double>, error string"""
FIELDS = [x.split()[0] for x in CHUNK_DDL.replace("\n", " ").split(", ")]
_KINDS = {"row_data": pa.map_(pa.string(), pa.string()), "row_evidence": pa.list_(pa.struct({"row_number": pa.int32(), "text": pa.string()})), "requires_vision": pa.bool_(), "region": pa.list_(pa.float64())}
CHUNK_SCHEMA = pa.schema([(f, _KINDS.get(f, pa.int32() if f.endswith("_number") else pa.string())) for f in FIELDS])
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_T = f"{_X}t"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Unsupported(ValueError):
    pass


def _row_chunks(sheet: str, rows: list[list[str]]) -> Iterator[dict]:
    if not rows:
        return
    header = rows[0]
    for n, row in enumerate(rows[1:], start=2):
        if row:  # a row of blank cells is a row; an empty line is none
            data = dict(zip(header, row + [""] * (len(header) - len(row)), strict=False))
            yield {"text": json.dumps(data, ensure_ascii=False), "row_data": data, "sheet_name": sheet, "row_number": n}


def _csv(data: bytes) -> Iterator[dict]:
    yield from _row_chunks("Sheet1", list(csv.reader(io.StringIO(data.decode("utf-8-sig")))))


@lru_cache(1 << 16)
def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet"):
            rows: list[list[str]] = []
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_X}row"):
                cells: list[str] = []
                for c in row.iter(f"{_X}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join([t.text or "" for t in c.iter(_T)])
                    elif (v := c.find(f"{_X}v")) is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                at = int(row.get("r") or len(rows) + 1)
                rows += [[]] * (at - 1 - len(rows))
                rows.append(cells)
            yield from _row_chunks(sheet.get("name"), rows)


def _xls(data: bytes) -> Iterator[dict]:
    for name, rows in xls.sheets(data):
        yield from _row_chunks(name, rows)


def _docx(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for n, p in enumerate(body.findall(f"{_W}p"), start=1):
        if said(p).strip():
            yield {"text": said(p), "paragraph_number": n}
    for n, table in enumerate(body.findall(f"{_W}tbl"), start=1):
        rows = ["\t".join(map(said, r.findall(f"{_W}tc"))) for r in table.findall(f"{_W}tr")]
        evidence = [{"row_number": k, "text": t} for k, t in enumerate(rows[1:], start=2)]
        for k in range(0, max(1, len(evidence)), ROWS_PER_CHUNK) if rows else ():
            some = evidence[k : k + ROWS_PER_CHUNK]
            if (text := "\n".join([rows[0], *(e["text"] for e in some)])).strip():
                yield {"text": text, "table_number": n, "row_evidence": some}


def _pdf(data: bytes) -> Iterator[dict]:
    for n, text in enumerate(pdf.page_texts(data), start=1):
        yield {"text": text, "page_number": n}


def _webp_size(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":  # lossy: 14 bits each, then a scale
        return tuple(x & 0x3FFF for x in struct.unpack("<HH", data[26:30]))
    if kind == b"VP8L" and data[20:21] == b"\x2f":  # lossless: 14 bits each, less one
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X" and len(data) >= 30:  # extended: 24 bits each, less one
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    return 0, 0


def _tiff_size(data: bytes) -> tuple[int, int]:
    """Of the first directory, in either byte order."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(f"{order}I", data[4:8])[0]
    found = {}
    for k in range(struct.unpack(f"{order}H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind = struct.unpack(f"{order}HH", entry[:4])
        if tag in (256, 257) and kind in (3, 4):
            found[tag] = struct.unpack(f"{order}{'H' if kind == 3 else 'I'}", entry[8 : 10 if kind == 3 else 12])[0]
    return found.get(256, 0), found.get(257, 0)


def _size(data: bytes) -> tuple[int, int]:
    """Width and height from the headers of PNG, BMP, JPEG, WebP and TIFF; zeros for others."""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp_size(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff_size(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM":
        return tuple(map(abs, struct.unpack("<ii", data[18:26])))
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + n
    return 0, 0


def _image(data: bytes) -> Iterator[dict]:
    yield {"text": "", "requires_vision": True, "region": [0.0, 0.0, *map(float, _size(data))]}


def _members(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Members of supported kinds. Paths that leave the archive, and archives beyond the limits, are refused as a whole."""
    members = [m for m in z.infolist() if not m.is_dir()]
    if len(members) > MAX_MEMBERS or sum(m.file_size for m in members) > MAX_UNPACKED:
        raise Unsupported("archive beyond the limits")
    for m in members:
        name = m.filename.replace("\\", "/")
        if name.startswith("/") or ":" in name or ".." in name.split("/"):
            raise Unsupported(f"unsafe member path {m.filename}")
    return [m for m in members if posixpath.splitext(m.filename)[1].lower() in READERS]


def _member_chunks(name: str, data: bytes) -> Iterator[dict]:
    for c in READERS[posixpath.splitext(name)[1].lower()](data):
        yield c | {"archive_member_path": "/".join(filter(None, (name, c.get("archive_member_path"))))}


def _zip(data: bytes) -> Iterator[dict]:
    """Chunks of all members of supported kinds."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in _members(z):
            yield from _member_chunks(m.filename, z.read(m))


def packed_members(path: str, data: bytes | None, length: int) -> Iterator[dict]:
    """The members of an archive by its central directory, as they lie in it; one row with the reason where it can't be read."""
    try:
        if data is None or length > MAX_BYTES:
            raise Unsupported("file over the size limit")
        out = []
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n, m in enumerate(_members(z)):
                first = m.header_offset + 30 + sum(struct.unpack_from("<HH", data, m.header_offset + 26))
                plain = m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or m.flag_bits & 1  # other methods, and a password's refusal
                out.append({"path": path, "n": n, "member": m.filename, "deflated": m.compress_type == zipfile.ZIP_DEFLATED and not plain, "crc": m.CRC, "size": m.file_size, "content": z.read(m) if plain else data[first : first + m.compress_size]})
        yield from out
    except Exception as e:  # noqa: BLE001  whatever a broken file raises concerns that file alone
        yield {"path": path, "n": -1, "error": f"{type(e).__name__}: {e}"}


def unpack(content: bytes, deflated: bool, crc: int, size: int) -> bytes:
    out = zlib.decompressobj(-15).decompress(content, size + 1) if deflated else content
    if len(out) != size or zlib.crc32(out) != crc:
        raise zipfile.BadZipFile("Bad CRC-32 or size of a member")
    return out


READERS = {".csv": _csv, ".xlsx": _xlsx, ".xls": _xls, ".docx": _docx, ".pdf": _pdf, ".zip": _zip} | dict.fromkeys(IMAGES, _image)


def chunks_of(path: str, data: bytes | None, length: int | None = None) -> Iterator[dict]:
    """A file's chunks; a file that can't be read is one row with the reason in error. Of more than BATCH chunks none are held: the file is read to its end first, then again."""
    suffix = posixpath.splitext(path)[1].lower()
    try:
        if suffix not in READERS:
            raise Unsupported(f"unsupported format {suffix}")
        if data is None or (length or len(data)) > MAX_BYTES:
            raise Unsupported("file over the size limit")
        read = iter(READERS[suffix](bytes(data)))
        held = list(islice(read, BATCH))
        rest = islice(READERS[suffix](bytes(data)), BATCH, None) if sum(1 for _ in read) else ()
        for c in chain(held, rest):
            yield {"path": path, "suffix": suffix} | c
    except Exception as e:  # noqa: BLE001  whatever a broken file raises concerns that file alone
        yield {"path": path, "suffix": suffix, "text": "", "error": f"{type(e).__name__}: {e}"}


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (path, length, content; content null where it is too large)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for k in range(b.num_rows):  # of a batch's files one at a time is copied
                for c in chunks_of(*(b.column(name)[k].as_py() for name in ("path", "content", "length"))):
                    held.append(c)
                    if len(held) >= BATCH:
                        yield _batch(held)
                        held = []
        yield _batch(held)

    return files.select("path", "length", "content").mapInArrow(run, CHUNK_DDL)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    pairs = ({"row_data": list(r["row_data"].items())} if r.get("row_data") is not None else {} for r in rows)
    return pa.RecordBatch.from_pylist([r | p for r, p in zip(rows, pairs, strict=True)], schema=CHUNK_SCHEMA)


def _frame(rows: list[dict], names: list[str] = FIELDS) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)


def archive_chunks(files: DataFrame) -> DataFrame:
    """Chunks of ZIP archives (path, length, content), each member in a task of its own choosing.

    A first pass takes archives apart without unpacking them; their members are dealt to all tasks and
    unpacked and read there. A member that can't be read fails its archive, as where that is read in one piece.
    """
    names = ["path", "n", "member", "deflated", "crc", "size", "content", "error"]

    def take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data, length in zip(b["path"], b["content"], b["length"], strict=True):
                for m in packed_members(p, data, length):
                    yield _frame([m], names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b.to_dict("records"):
                base = {"path": m["path"], "suffix": ".zip", "n": m["n"]}
                try:
                    if m["error"] is not None:
                        got = [base | {"text": "", "error": m["error"]}]
                    else:
                        got = [base | c for c in _member_chunks(m["member"], unpack(bytes(m["content"]), m["deflated"], int(m["crc"]), int(m["size"])))]
                except Exception as e:  # noqa: BLE001
                    got = [base | {"text": "", "error": f"{type(e).__name__}: {e}"}]
                if got:
                    yield _frame(got, [*FIELDS, "n"])

    apart = files.select("path", "length", "content").mapInPandas(take_apart, "path string, n long, member string, deflated boolean, crc long, size long, content binary, error string")
    read = materialise(apart.repartition("path", "n").mapInPandas(run, f"{CHUNK_DDL}, n long"), "archive-chunks")
    failed = read.where("error is not null").groupBy("path").agg(F.min_by("error", "n").alias("error"))
    refused = failed.select("path", F.lit(".zip").alias("suffix"), F.lit("").alias("text"), "error")
    return reads(read.join(failed.select("path"), "path", "left_anti").select(*FIELDS).unionByName(refused, allowMissingColumns=True), read)


def read_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= MAX_BYTES).select("path", "length", "content")  # reaches the source: larger files are not loaded
    large = files.where(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"))
    every = small.unionByName(large)
    archive = F.lower("path").endswith(".zip")
    members = archive_chunks(every.where(archive))
    return reads(chunks(every.where(~archive)).unionByName(members), members)


def as_pdf(texts: DataFrame, lines: int = 40) -> DataFrame:
    """(path, length, content): a PDF file of each text (name, text), `lines` lines a page, written in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [(t or "").split("\n") for t in b["text"]]
            data = [pdf.write([s[i : i + lines] for i in range(0, len(s), lines)]) for s in said]
            yield pd.DataFrame({"path": b["name"], "length": list(map(len, data)), "content": data})

    return texts.select("name", "text").mapInPandas(run, "path string, length long, content binary")


def as_tables(rows: DataFrame, suffix: str, rows_a_file: int = 1000) -> DataFrame:
    """(path, length, content): rows (seq, then cells) as XLSX or DOCX files of a header and `rows_a_file` rows at most, by seq; written in tasks.

    A file holds the rows whose seq lies in one range of `rows_a_file` numbers, so seq must not repeat. The files are
    counted first and dealt to a task for each FILES_A_TASK, so that what a task sorts, writes and reads does not grow with the rows.
    """
    names = [c for c in rows.columns if c != "seq"]
    make = {".xlsx": lambda cells: ooxml.workbook({"Sheet1": cells}), ".docx": lambda cells: ooxml.document([], [cells])}[suffix]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        data = make([names, *part[names].astype(object).where(part[names].notna(), None).values.tolist()])
        return pd.DataFrame({"path": [f"{part['__file'].iloc[0]}{suffix}"], "length": [len(data)], "content": [data]})

    dealt = rows.select("seq", *(F.col(c).cast("string").alias(c) for c in names)).withColumn("__file", F.floor(F.col("seq") / rows_a_file))
    tasks = -(-dealt.select("__file").distinct().count() // FILES_A_TASK)
    return dealt.repartition(max(1, tasks), "__file").groupBy("__file").applyInPandas(run, "path string, length long, content binary")


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Drafts as JSON lines with the canonical schema."""
    return spark.read.schema(RECORD_DDL).json(path)
