"""Statement files from bytes to drafts: writers, statuses, chunk files, and batches that come again."""

import csv
import io
import os
import random
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from fundweave import scratch
from fundweave.sources import commits, files, ingest, ooxml, repository
from fundweave.streaming import ingest as stream

HEADER = ["交易流水号", "交易时间", "付款账号", "收款账号", "交易金额"]


def rows(*serials, payer="A1"):
    return [HEADER, *([s, "2026-01-02 03:04:05", payer, "B2", "10.50"] for s in serials)]


def as_csv(cells):
    held = io.StringIO()
    csv.writer(held).writerows(cells)
    return held.getvalue().encode()


def put(folder, name, data):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_bytes(data)


def state(spark, case):
    drafts = sorted((r.serial_number, r.review_status, r.source.source_file_id, r.transaction_id) for r in repository.list_drafts(spark, case).collect())
    return drafts, {r.file_name: (r.status, r.chunk_count, r.draft_count, r.error_count) for r in repository.list_materials(spark, case).collect()}


def test_workbooks_and_documents_round_trip():
    rng = random.Random(1)
    cell = lambda: "".join(rng.choice("ab <>&\"'中\n\t😀0") for _ in range(rng.randint(1, 8)))
    for _ in range(50):
        wide = rng.randint(1, 30)
        cells = [[f"h{k}" for k in range(wide)], *([cell() for _ in range(wide)] for _ in range(rng.randint(0, 20)))]
        got = list(files.chunks_of("x.xlsx", ooxml.workbook({"一 <1>": cells, "empty": []})))
        assert [list(c["row_data"].values()) for c in got] == cells[1:] and all(c["sheet_name"] == "一 <1>" for c in got)
        assert [c["row_number"] for c in got] == list(range(2, len(cells) + 1))
        paragraphs = [cell() for _ in range(5)] + ["", " "]
        got = list(files.chunks_of("x.docx", ooxml.document(paragraphs, [cells])))
        assert [(c["paragraph_number"], c["text"]) for c in got if "paragraph_number" in c] == [(n, p) for n, p in enumerate(paragraphs, 1) if p.strip()]
        tables = [c for c in got if "table_number" in c]
        assert [e["text"] for c in tables for e in c["row_evidence"]] == ["\t".join(r) for r in cells[1:]] and all(len(c["row_evidence"]) <= 8 for c in tables)
    bad = list(files.chunks_of("x.xlsx", ooxml.workbook({"s": [["a"], ["\x00\x0b\r"], [None], []]})))
    assert [c["row_data"] for c in bad] == [{"a": "\ufffd\ufffd\r"}]  # no form in XML; rows without cells are none


def test_rows_as_files_of_bounded_size(spark):
    d = spark.range(25).select(F.col("id").alias("seq"), F.when(F.col("id") != 7, F.concat(F.lit("x"), "id")).alias("a"), F.lit(1.5).alias("b"))
    got = files.chunks(files.as_tables(d, ".xlsx", 10)).select("path", "row_number", "row_data").collect()
    assert sorted((r.path, r.row_number, r.row_data["a"]) for r in got) == sorted((f"{k // 10}.xlsx", k % 10 + 2, "" if k == 7 else f"x{k}") for k in range(25))
    assert files.as_tables(d.limit(0), ".docx").count() == 0


def test_files_are_dealt_by_their_number(spark):
    """A task makes some sixteen files, however many rows there are and however few bytes they take."""
    d = spark.range(5000).select(F.col("id").alias("seq"), F.concat(F.lit("x"), "id").alias("a"))
    made = files.as_tables(d, ".xlsx", 10)
    held = made.groupBy(F.spark_partition_id()).count().select("count").collect()
    assert sum(r[0] for r in held) == 500 and max(r[0] for r in held) <= 48
    assert sorted(r.row_data["a"] for r in files.chunks(made).select("row_data").collect()) == sorted(f"x{k}" for k in range(5000))


def test_statuses_chunk_files_and_repeated_batches(spark, tmp_path):
    inbox, case = tmp_path / "in", str(tmp_path / "case")
    put(inbox, "good.csv", as_csv(rows("S1", "S2")))
    put(inbox, "again.csv", as_csv(rows("S1", "S2")))  # the same bytes: one material, under the lesser name
    put(inbox, "part[1].csv", as_csv([*rows("S3"), *rows("S4", payer="")[1:]]))  # a name that is a pattern, a row without payer
    put(inbox, "refused.csv", as_csv(rows("S5", payer="")))
    put(inbox, "broken.xlsx", b"no archive")
    put(inbox, "note.txt", b"x")
    put(inbox, "letter.docx", ooxml.document(["付款账号 and 收款账号"], []))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("d/book.xlsx", ooxml.workbook({"s": rows("S6", "S6")}))
    put(inbox, "all.zip", held.getvalue())
    paths = [f"file:{p}" for p in sorted(inbox.iterdir())]
    ingest.parse_materials(spark, paths, case, ("s", 0))
    drafts, materials = state(spark, case)
    assert [d[0] for d in drafts] == ["S1", "S2", "S3", "S6", "S6"]
    assert materials == {
        "again.csv": ("parsed", 2, 2, 0), "part[1].csv": ("partial", 2, 1, 1), "refused.csv": ("failed", 1, 0, 1), "broken.xlsx": ("failed", 0, 0, 1),
        "note.txt": ("failed", 0, 0, 1), "letter.docx": ("extracted", 1, 0, 0), "all.zip": ("parsed", 2, 2, 0),
    }
    made = f"{case}/extracted/s-{0:020d}"
    raw, classed, errors = (spark.read.json(f"{made}/{n}") for n in ("raw", "classified", "errors"))
    assert "classification" not in raw.columns and raw.count() == classed.count() == 10
    assert classed.where("paragraph_number = 1").first().classification.record_type == "bank_transfer"
    assert sorted(r.status for r in errors.collect()) == ["failed", "failed", ingest.NEEDS_REVIEW, ingest.NEEDS_REVIEW]
    # a confirmed record stays through the same files in a later batch, and a batch that comes again changes nothing at all
    repository.update_draft(spark, case, drafts[0][3], {"review_status": "confirmed"})
    before, number = state(spark, case), commits.latest(spark, f"{case}/drafts/log")[0]
    ingest.parse_materials(spark, paths, case, ("s", 0))
    assert state(spark, case) == before and commits.latest(spark, f"{case}/drafts/log")[0] == number
    ingest.parse_materials(spark, paths, case, ("s", 1))
    assert state(spark, case) == before and commits.latest(spark, f"{case}/drafts/log")[0] == number + 1


def test_a_batch_leaves_no_tables_and_its_rows_compressed(spark, tmp_path):
    inbox, case, shared = tmp_path / "in", str(tmp_path / "case"), Path(scratch.scratch_dir(spark).removeprefix("file://"))
    put(inbox, "a.csv", as_csv(rows(*(f"S{k}" for k in range(500)))))
    paths, before = [f"file:{inbox}/a.csv"], set(os.listdir(shared)) if shared.exists() else set()
    for batch in (0, 1):  # the second finds earlier records
        ingest.parse_materials(spark, paths, case, ("s", batch))
    assert {n.rpartition("-")[0] for n in set(os.listdir(shared)) - before} == {"ingest-done"}  # what the result reads
    for name in ("raw", "classified"):
        made = list(Path(case).glob(f"extracted/s-{1:020d}/{name}/part-*"))
        back = spark.read.json(f"{case}/extracted/s-{1:020d}/{name}")
        assert back.count() == 500 and sum(p.stat().st_size for p in made) < 500 * 60  # some 600 bytes a row as text
        assert sorted(r.row_number for r in back.select("row_number").collect()) == list(range(2, 502))
    assert [d[0] for d in state(spark, case)[0]] == sorted(f"S{k}" for k in range(500))


def test_a_stream_takes_each_file_once(spark, tmp_path):
    inbox, case, at = tmp_path / "in", str(tmp_path / "case"), str(tmp_path / "checkpoint")
    go = lambda where=at: stream.watch_materials(spark, f"file:{inbox}", case, where, files_per_batch=2).awaitTermination()
    for k in range(3):
        put(inbox, f"{k}.csv", as_csv(rows(f"S{k}")))
    go()
    first = state(spark, case)
    assert [d[0] for d in first[0]] == ["S0", "S1", "S2"] and len(first[1]) == 3
    go()
    assert state(spark, case) == first
    put(inbox / "deep", "3.csv", as_csv(rows("S3")))
    go()
    assert [d[0] for d in state(spark, case)[0]] == ["S0", "S1", "S2", "S3"]
    put(inbox, "4.csv", as_csv(rows("S4")))
    go(str(tmp_path / "other"))  # a new checkpoint reads all files again: records meet their earlier selves
    assert [d[0] for d in state(spark, case)[0]] == ["S0", "S1", "S2", "S3", "S4"]
