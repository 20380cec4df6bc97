"""A case's folder on a shared file system: drafts, confirmed versions, seeds, cases, materials and the audit log.

Every table has a commit log (commits.py): readers see whole states, and of writers that meet none
loses what another wrote. Drafts lie in parts by serial number; a change reads, marks and writes only the parts it
touches. Audit lines and version files follow from the log's entries.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_account, random_id
from ..operators import dedup, filters, reconcile, running
from ..schema import RECORD_DDL
from ..scratch import drop, materialise
from . import commits

SEED_DDL = "seed_id string, victim_id string, transaction_id string, amount decimal(18,2), note string"
VERSION_DDL = "version_id string, name string, created_at string, record_count long, sha256 string, csv_path string"
CASE_DDL = "case_id string, name string, status string, reported_loss double, updated_at string"
MATERIAL_DDL = "material_id string, file_name string, status string, sha256 string"
#: As materials are kept: those that were not read yet have no counts.
KEPT_MATERIAL_DDL = f"{MATERIAL_DDL}, chunk_count long, draft_count long, error_count long"
NESTED = ("source", "evidence_locations", "confidence")


#: Parts of a new case's drafts; a change rewrites the parts of the serials that it touches.
PARTS = 16
#: Tasks that write a part; families are counted in so many slots, and those of a slot with more than BUSY rows are marked by joins, not as windows.
WRITERS, SLOTS, BUSY = 8, 1 << 16, 200_000
BULK_NOTE = "批量人工确认"


def _log(folder: str, name: str) -> str:
    return f"{folder}/{name}/log"


def _publish(spark: SparkSession, folder: str, name: str):
    """What follows a commit: its audit lines, and a version's file under its own name."""

    def run(number: int, entry: dict) -> None:
        if file := entry.get("file"):
            target = f"{folder}/{entry['version']['csv_path']}"
            if not commits.exists(spark, target):
                commits.move(spark, f"{folder}/{file}", target)
        if event := entry.get("event"):
            path = f"{folder}/audit/{name}-{number:020d}.json"
            if not commits.exists(spark, path):
                commits.claim(spark, path, (json.dumps(event, ensure_ascii=False) + "\n").encode())
        if rows := entry.get("events"):
            own, target = commits.fs(spark, f"{folder}/audit/{name}-{number:020d}-rows")
            if not own.exists(target):
                own.mkdirs(target.getParent())
                own.rename(commits.fs(spark, rows)[1], target)

    return run


def _event(event: str, **fields) -> dict:
    return {"timestamp": datetime.now(UTC).isoformat(), "event": event, **{k: str(v) for k, v in fields.items()}}


def append_audit(spark: SparkSession, folder: str, event: str, **fields) -> None:
    """A line of its own file, so that writers do not meet."""
    commits.claim(spark, f"{folder}/audit/{uuid.uuid4().hex}.json", (json.dumps(_event(event, **fields), ensure_ascii=False) + "\n").encode())


AUDIT_DDL = "timestamp string, event string, count string, source_file_id string, replace_missing string, transaction_id string, fields string, version_id string, sha256 string, seed_id string"


def list_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the order of their times; those that a crash kept from being written are written first."""
    for name in ("drafts", "versions", "seeds", "cases", "materials"):
        for number, entry in commits.entries(spark, _log(folder, name)):
            _publish(spark, folder, name)(number, entry)
    if not commits.exists(spark, f"{folder}/audit"):
        return spark.createDataFrame([], AUDIT_DDL)
    return spark.read.schema(AUDIT_DDL).option("recursiveFileLookup", "true").json(f"{folder}/audit").orderBy("timestamp")


def _current(spark: SparkSession, folder: str, name: str, ddl: str) -> DataFrame:
    _, entry = commits.latest(spark, _log(folder, name))
    return spark.read.schema(ddl).json(entry["data"]) if entry else spark.createDataFrame([], ddl)


def _replace(spark: SparkSession, folder: str, name: str, ddl: str, change, event: dict | None = None) -> bool:
    """Replace a table by change(table); None changes nothing. Tables of earlier entries stay for their readers until clean()."""

    def attempt(number: int, entry: dict) -> dict | None:
        old = spark.read.schema(ddl).json(entry["data"]) if entry else spark.createDataFrame([], ddl)
        if (new := change(old)) is None:
            return None
        path = f"{folder}/{name}/data/{uuid.uuid4().hex}"
        new.write.json(path)
        return {"data": path, "fresh": [path], "event": event}

    before = commits.latest(spark, _log(folder, name))[0]
    return commits.transact(spark, _log(folder, name), attempt, _publish(spark, folder, name))[0] > before


# Drafts: parts by serial (by the exact key where there is none), so duplicates and conflicts lie within a part.

DRAFT_DDL = f"seq long, {RECORD_DDL}"


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(dedup.family()), F.lit(parts)).cast("int")


def _source() -> Column:
    return F.col("source.source_file_id")


def _read(spark: SparkSession, entry: dict, only: set[int] | None = None) -> DataFrame:
    paths = [path for k, path in entry.get("parts", {}).items() if only is None or int(k) in only]
    return spark.read.schema(DRAFT_DDL).parquet(*paths) if paths else spark.createDataFrame([], DRAFT_DDL)


def _touched(rows: DataFrame, parts: int) -> set[int]:
    return {r[0] for r in rows.select(_part(parts).alias("p")).distinct().collect()}  # the number of parts at most


def _marked(rows: DataFrame, parts: int) -> DataFrame:
    """rows with part and their marks, dealt to WRITERS tasks a part by family. Rows of a very large family are marked by joins and dealt one by one."""
    slot = F.pmod(F.xxhash64(dedup.family()), F.lit(SLOTS)).cast("int")
    busy = [r[0] for r in rows.groupBy(slot.alias("s")).count().where(F.col("count") > BUSY).collect()]  # a share of 1 / BUSY of the rows at most
    placed = rows.withColumn("part", _part(parts))
    calm = placed.where(~slot.isin(busy)) if busy else placed
    # one shuffle: what the marks need lies together then, in the order in which it is written
    calm = calm.withColumn("__writer", F.pmod(F.shiftright(F.xxhash64(dedup.family()), 24), F.lit(WRITERS)).cast("int")).repartition("part", "__writer")
    calm = dedup.mark_together(calm, ["part", "__writer"]).select(*placed.columns)
    if not busy:
        return calm
    large = dedup.mark(placed.where(slot.isin(busy))).select(*placed.columns).repartition("part", F.pmod(F.xxhash64("transaction_id"), F.lit(WRITERS)))
    return calm.unionByName(large)


def _stored(spark: SparkSession, folder: str, entry: dict, affected: set[int], dealt: DataFrame, **fields) -> dict:
    """The entry after the affected parts were replaced by dealt, rows with part."""
    path = f"{folder}/drafts/data/{uuid.uuid4().hex}"
    dealt.write.partitionBy("part").parquet(path)
    made = {n.split("=")[1]: f"{path}/{n}" for n in commits.names(spark, path) if n.startswith("part=")}
    kept = {k: v for k, v in entry.get("parts", {}).items() if int(k) not in affected}
    return {"of": entry["of"], "parts": kept | made, "next_seq": entry.get("next_seq", 1), "batches": entry.get("batches", {}), "read_parts": sorted(affected), "fresh": [path], **fields}


def _write(spark: SparkSession, folder: str, entry: dict, affected: set[int], rows: DataFrame, **fields) -> dict:
    """The entry after the affected parts were replaced by rows, marked anew; the other parts stay as they are."""
    return _stored(spark, folder, entry, affected, _marked(rows, entry["of"]), **fields)


def _change(spark: SparkSession, folder: str, change, parts: int = PARTS) -> tuple[int, dict]:
    """Commit a change of the drafts. change gets the entry and gives the new one, or None."""
    start = lambda entry: entry or {"of": parts, "parts": {}, "next_seq": 1}
    return commits.transact(spark, _log(folder, "drafts"), lambda number, entry: change(start(entry)), _publish(spark, folder, "drafts"))


def list_drafts(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, commits.latest(spark, _log(folder, "drafts"))[1])


def save_drafts(drafts: DataFrame, folder: str, parts: int = PARTS) -> None:
    """Replace the drafts as a whole. A seq column keeps the records' order."""
    spark = drafts.sparkSession
    drafts = materialise(drafts.select(*spark.createDataFrame([], DRAFT_DDL).columns), "drafts-new")
    end = (drafts.agg(F.max("seq")).first()[0] or 0) + 1
    _change(spark, folder, lambda entry: _write(spark, folder, entry, set(range(entry["of"])), drafts) | {"next_seq": max(end, entry["next_seq"])}, parts)
    drop(drafts)


def export_drafts(spark: SparkSession, folder: str, path: str) -> None:
    """Drafts as JSON lines in their order."""
    list_drafts(spark, folder).orderBy("seq").drop("seq").write.option("ignoreNullFields", "false").json(path)


def _complete(new: DataFrame) -> DataFrame:
    """Records with an id, cleaned accounts and their first evidence; written, so that random ids stay what they are."""
    columns = new.sparkSession.createDataFrame([], DRAFT_DDL).schema
    full = new.select(*(F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns))
    located = F.when((F.size(F.coalesce("evidence_locations", F.array())) == 0) & _source().isNotNull(), F.array("source")).otherwise(F.col("evidence_locations"))
    full = full.withColumns({"transaction_id": F.coalesce("transaction_id", random_id("TX-", 12)), "evidence_locations": located, "payer_account": clean_account(F.col("payer_account")), "payee_account": clean_account(F.col("payee_account"))})
    return materialise(full, "drafts-new")


def add_drafts(new: DataFrame, folder: str) -> DataFrame:
    """Append records, mark duplicates and conflicts of their serials anew, and give the new records as marked."""
    spark = new.sparkSession
    new = _complete(new)
    n, last = new.agg(F.count("*"), F.max("seq")).first()

    def change(entry: dict) -> dict:
        own = new.withColumn("seq", F.col("seq") + entry["next_seq"])
        affected = _touched(own, entry["of"])
        after = _write(spark, folder, entry, affected, _read(spark, entry, affected).unionByName(own), event=_event("drafts_created", count=n))
        return after | {"first_seq": entry["next_seq"], "next_seq": entry["next_seq"] + (last or 0) + 1}

    _, entry = _change(spark, folder, change)
    drop(new)
    return _read(spark, entry, set(entry["read_parts"])).where(F.col("seq") >= entry["first_seq"])


def reconcile_source(new: DataFrame, folder: str, source_file_id: str, replace_missing: bool) -> DataFrame:
    """Bring a source's records up to what was read from it now (reconcile.reconcile) and give the records that stand for new, as marked.

    Only the parts that hold the source's serials, old or new, are read and written.
    """
    spark = new.sparkSession
    new = _complete(new)

    def change(entry: dict) -> dict:
        of_source = _source().eqNullSafe(F.lit(source_file_id))
        old = _read(spark, entry).where(of_source)
        merged = materialise(reconcile.reconcile(old, new, source_file_id, replace_missing), "drafts-merged")
        ordered = running.places(merged, [F.asc("seq")], "drafts-ordered")
        drop(merged)
        placed = materialise(ordered.withColumn("seq", F.col("place") + entry["next_seq"] - 1).drop("place"), "drafts-placed")
        drop(ordered)
        total, created = placed.agg(F.count("*"), F.count_if(F.col("origin") != "leftover")).first()
        affected = _touched(old, entry["of"]) | _touched(placed, entry["of"])
        rest = _read(spark, entry, affected).where(~of_source)
        event = _event("source_drafts_reconciled", source_file_id=source_file_id, count=created, replace_missing=replace_missing)
        after = _write(spark, folder, entry, affected, rest.unionByName(placed.drop("origin")), event=event)
        drop(placed)
        return after | {"first_seq": entry["next_seq"], "created": created, "next_seq": entry["next_seq"] + total}

    _, entry = _change(spark, folder, change)
    drop(new)
    return _read(spark, entry, set(entry["read_parts"])).where((F.col("seq") >= entry["first_seq"]) & (F.col("seq") < entry["first_seq"] + entry["created"]))


def reconcile_sources(new: DataFrame, folder: str, sources: DataFrame, batch: tuple[str, int]) -> bool:
    """reconcile_source() for many sources in one commit. sources: source_file_id and replace_missing, a row for each source of new.

    batch: (stream, number). The commit holds the stream's last number; a number that is not above it changes
    nothing, so a batch that comes again after a crash is taken once. Whether anything changed.
    """
    spark = new.sparkSession
    stream, number = batch
    before = commits.latest(spark, _log(folder, "drafts"))[1]
    if before.get("batches", {}).get(stream, -1) >= number:
        return False
    new = _complete(new)
    mine = materialise(sources.select(F.col("source_file_id").alias("__file"), "replace_missing"), "drafts-sources")
    n_new = new.count()

    def change(entry: dict) -> dict | None:
        if entry.get("batches", {}).get(stream, -1) >= number:
            return None
        old = _read(spark, entry).join(mine, _source() == F.col("__file"), "left_semi")
        merged = reconcile.merge(old, new).join(mine, _source() == F.col("__file"), "left")
        merged = merged.where((F.col("origin") != "leftover") | ~F.col("replace_missing")).drop("__file", "replace_missing")
        merged = materialise(merged, "drafts-merged")
        ordered = running.places(merged, [F.asc("seq")], "drafts-ordered")
        drop(merged)
        placed = materialise(ordered.withColumn("seq", F.col("place") + entry["next_seq"] - 1).drop("place"), "drafts-placed")
        drop(ordered)
        affected = _touched(old, entry["of"]) | _touched(placed, entry["of"])
        rest = _read(spark, entry, affected).join(mine, _source() == F.col("__file"), "left_anti")
        event = _event("source_drafts_reconciled", source_file_id=f"{stream}-{number}", count=n_new)
        after = _write(spark, folder, entry, affected, rest.unionByName(placed.drop("origin")), event=event, batches=entry.get("batches", {}) | {stream: number})
        total = placed.count()
        drop(placed)
        return after | {"next_seq": entry["next_seq"] + total}

    start = commits.latest(spark, _log(folder, "drafts"))[0]
    changed = _change(spark, folder, change)[0] > start
    drop(new, mine)
    return changed


def replace_source(new: DataFrame, folder: str, source_file_id: str) -> DataFrame:
    return reconcile_source(new, folder, source_file_id, True)


def update_draft(spark: SparkSession, folder: str, transaction_id: str, changes: dict) -> DataFrame:
    """Change one record (None: no change) and give it as marked; KeyError if there is none. One that ends confirmed is human_confirmed."""
    mine = F.col("transaction_id") == transaction_id

    def change(entry: dict) -> dict:
        old = _read(spark, entry).where(mine)
        if old.isEmpty():
            raise KeyError(transaction_id)
        changed = reconcile.update(old, transaction_id, changes)
        affected = _touched(old, entry["of"]) | _touched(changed, entry["of"])
        rest = _read(spark, entry, affected).where(~mine | F.col("transaction_id").isNull())
        return _write(spark, folder, entry, affected, rest.unionByName(changed), event=_event("draft_updated", transaction_id=transaction_id, fields=list(changes)))

    _, entry = _change(spark, folder, change)
    return _read(spark, entry, set(entry["read_parts"])).where(mine)


def confirm_all(spark: SparkSession, folder: str) -> int:
    """Confirm all pending records, with a note and an audit line for each; gives the number of all records."""
    pending = F.col("review_status") == "pending"

    def change(entry: dict) -> dict | None:
        open_ = _read(spark, entry).where(pending)
        if not (affected := _touched(open_, entry["of"])):
            return None
        rows = _read(spark, entry, affected)
        done = rows.withColumns({"review_note": F.when(pending, BULK_NOTE).otherwise(F.col("review_note")), "provenance": F.when(pending, "human_confirmed").otherwise(F.col("provenance"))})
        events = f"{folder}/drafts/data/{uuid.uuid4().hex}-events"
        lines = _event("draft_updated", fields=["review_status", "review_note"])
        open_.select(*(F.lit(v).alias(k) for k, v in lines.items()), "transaction_id").write.json(events)
        # neither marks nor parts depend on what changes here, so rows are written where they were read
        after = _stored(spark, folder, entry, affected, reconcile.confirm_all(done).withColumn("part", _part(entry["of"])), events=events)
        return after | {"fresh": [*after["fresh"], events]}

    _, entry = _change(spark, folder, change)
    return _read(spark, entry).count()


def clean(spark: SparkSession, folder: str, name: str, keep: int = 5) -> int:
    """Remove tables that none of the last `keep` entries names, nor one that a writer works on now (run it while none does); gives how many went. The log stays."""
    held = set()
    for _, entry in commits.entries(spark, _log(folder, name))[-keep:]:
        for path in [*entry.get("parts", {}).values(), entry.get("data") or "", entry.get("events") or "", entry.get("file") or ""]:
            held |= {p for p in path.split("/") if p}
    gone = [n for n in commits.names(spark, f"{folder}/{name}/data") if n not in held]
    for n in gone:
        commits.remove(spark, f"{folder}/{name}/data/{n}")
    return len(gone)


# Versions

def version_rows(drafts: DataFrame) -> DataFrame:
    """Canonical records in the fixed field order, nested fields as JSON, by seq."""
    kept = dedup.canonical(drafts)
    names = [f.name for f in drafts.schema if f.name != "seq"]
    return kept.orderBy("seq").select(*(F.to_json(c).alias(c) if c in NESTED else F.col(c).cast("string").alias(c) for c in names))


def csv_lines(records: DataFrame) -> DataFrame:
    """(seq, line): each record as one CSV line, made in tasks. Numbers, times and nested fields are written as Python's json and csv do."""
    names = [f.name for f in records.schema if f.name != "seq"]
    nested = {c: records.schema[c].dataType.simpleString() for c in NESTED if c in names}

    def cell(name: str, value):
        if name in nested:
            empty = {"source": None, "evidence_locations": [], "confidence": {}}[name]
            return json.dumps(json.loads(value) if value is not None else empty, ensure_ascii=False)
        if isinstance(value, Decimal):
            return repr(float(value))
        return value.isoformat() if isinstance(value, datetime) else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                held = io.StringIO()
                csv.writer(held, lineterminator="").writerow([cell(n, v) for n, v in zip(names, row, strict=True)])
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["seq", "line"])

    flat = [F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if c in nested else F.col(c) for c in names]
    return records.select(F.col("seq").cast("long").alias("seq"), *flat).mapInArrow(run, "seq long, line string")


def _hand_over(spark: SparkSession, lines: DataFrame, path: str, head: str) -> str:
    """Write lines by seq as one file and give its SHA-256: tasks write parts, then the parts' bytes are joined in order and hashed on the way."""
    parts = f"{path}.parts"
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select("line").write.option("lineSep", "\r\n").text(parts)
    jvm = spark._jvm
    own, where = commits.fs(spark, path)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    out = jvm.java.security.DigestOutputStream(own.create(where, True), digest)
    out.write(head.encode())
    for name in sorted((n for n in commits.names(spark, parts) if n.startswith("part-")), key=lambda n: int(n.split("-")[1])):
        stream = own.open(commits.fs(spark, f"{parts}/{name}")[1])
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)  # a buffer at a time, inside the JVM
        stream.close()
    out.close()
    commits.remove(spark, parts)
    return bytes(digest.digest()).hex()


def create_version(spark: SparkSession, folder: str, name: str) -> dict:
    """Write the confirmed records as one CSV file with a byte-order mark and its SHA-256; refused unless all are confirmed.

    The file is written under a fresh name; the entry that claims the version's number also says where it
    lies, and it gets its own name after that. So two callers get two numbers, and a crash leaves no half version.
    """

    def change(number: int, entry: dict) -> dict:
        drafts = list_drafts(spark, folder)
        kept = dedup.canonical(drafts)
        n, open_ = kept.agg(F.count("*"), F.count_if(~filters.status("confirmed") | F.col("review_status").isNull())).first()
        if not n or open_:
            raise ValueError("all draft transactions must be confirmed")
        version_id, file = f"V{number + 1:03d}", f"versions/data/{uuid.uuid4().hex}.csv"
        head = "\ufeff" + ",".join(c for c in drafts.columns if c != "seq") + "\r\n"
        sha256 = _hand_over(spark, csv_lines(kept), f"{folder}/{file}", head)
        version = {"version_id": version_id, "name": name, "created_at": datetime.now(UTC).isoformat(), "record_count": n, "sha256": sha256, "csv_path": f"versions/{version_id}.csv"}
        return {"version": version, "file": file, "fresh": [f"{folder}/{file}"], "event": _event("version_created", version_id=version_id, sha256=sha256)}

    return commits.transact(spark, _log(folder, "versions"), change, _publish(spark, folder, "versions"))[1]["version"]


def list_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions in the order of their numbers, so that V1000 follows V999."""
    return spark.createDataFrame([e["version"] for _, e in commits.entries(spark, _log(folder, "versions"))], VERSION_DDL)


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    return list_versions(spark, folder).orderBy(F.desc(F.length("version_id")), F.desc("version_id")).limit(1)


def download_version(spark: SparkSession, folder: str, version_id: str, case_id: str) -> tuple[str, str]:
    """(the file's path, the name to save it under); KeyError if there is no such version."""
    for number, entry in commits.entries(spark, _log(folder, "versions")):
        if entry["version"]["version_id"] == version_id:
            _publish(spark, folder, "versions")(number, entry)
            return f"{folder}/{entry['version']['csv_path']}", f"{case_id}-{version_id}-confirmed.csv"
    raise KeyError(version_id)


def read_version(spark: SparkSession, folder: str, version_id: str) -> DataFrame:
    """A version's records, read back from its file with their types."""
    path, _ = download_version(spark, folder, version_id, "")
    schema = spark.createDataFrame([], RECORD_DDL).schema
    text = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    typed = lambda f: F.from_json(f.name, f.dataType.simpleString()) if f.name in NESTED else F.col(f.name).cast(f.dataType)
    return text.select(*(typed(f).alias(f.name) for f in schema))


# Seeds, cases, materials

def list_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder, "seeds", SEED_DDL)


def save_seed(spark: SparkSession, folder: str, seed: dict) -> None:
    row = spark.createDataFrame([seed], SEED_DDL)
    _replace(spark, folder, "seeds", SEED_DDL, lambda old: old.unionByName(row), _event("seed_confirmed", seed_id=seed["seed_id"], transaction_id=seed["transaction_id"]))


def delete_seed(spark: SparkSession, folder: str, seed_id: str) -> bool:
    """Whether there was such a seed."""
    mine = F.col("seed_id") == seed_id
    change = lambda old: None if old.where(mine).isEmpty() else old.where(~mine)
    return _replace(spark, folder, "seeds", SEED_DDL, change, _event("seed_cancelled", seed_id=seed_id))


def save_cases(cases: DataFrame, folder: str) -> None:
    _replace(cases.sparkSession, folder, "cases", CASE_DDL, lambda old: cases)


def list_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases, the one changed last first."""
    return _current(spark, folder, "cases", CASE_DDL).orderBy(F.desc("updated_at"), "case_id")


def set_status(cases: DataFrame, case_id: str, status: str) -> DataFrame:
    """A case's status; whatever is not archived is active."""
    now = "archived" if status == "archived" else "active"
    return cases.withColumn("status", F.when(F.col("case_id") == case_id, now).otherwise(F.col("status")))


def list_materials(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder, "materials", KEPT_MATERIAL_DDL)


def save_materials(materials: DataFrame, folder: str) -> None:
    _replace(materials.sparkSession, folder, "materials", KEPT_MATERIAL_DDL, lambda old: materials)


def update_materials(changed: DataFrame, folder: str) -> None:
    """Replace the materials that changed, by id; the others stay."""
    fields = changed.sparkSession.createDataFrame([], KEPT_MATERIAL_DDL).columns
    rows = changed.select(*(c for c in fields if c in changed.columns))
    _replace(changed.sparkSession, folder, "materials", KEPT_MATERIAL_DDL, lambda old: old.join(rows.select("material_id"), "material_id", "left_anti").unionByName(rows, allowMissingColumns=True))


def material_counts(materials: DataFrame) -> DataFrame:
    """How many materials are in work, failed or read in part."""
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    return materials.agg(of("queued", "parsing").alias("active"), of("failed").alias("failed"), of("partial").alias("partial"))


def reported_losses(victims: DataFrame) -> DataFrame:
    """(case_id, reported_loss): what a case's victims reported together."""
    return victims.groupBy("case_id").agg(F.sum("reported_loss").alias("reported_loss"))


def seed_total(seeds: DataFrame) -> DataFrame:
    """What all seeds amount to, 0 for none."""
    return seeds.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"))


def labelled(records: DataFrame, materials: DataFrame) -> DataFrame:
    """records (source_file_id) with their material's file name, which is unknown for deleted ones."""
    names = materials.select(F.col("material_id").alias("source_file_id"), "file_name")
    return records.join(names, "source_file_id", "left")


def appearances(found: DataFrame) -> DataFrame:
    """(serial_number, n) of what appears in several files or several times in one."""
    return found.groupBy("serial_number").agg(F.count("*").alias("n")).where("n > 1")


def first_seen(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column in the order in which they first occur by seq."""
    return rows.groupBy(column).agg(F.min("seq").alias("first")).orderBy("first").select(column)


#: The share of records that must be right, by suffix; for all others the last.
ACCURACY = {".csv": 1.0, ".xlsx": 1.0, "": 0.9}


def write_report(metrics: DataFrame, totals: DataFrame, folder: str) -> dict:
    """Write report.json and report.md. metrics: reconcile.format_metrics() by suffix, a row for each file format; totals: one row."""
    spark = metrics.sparkSession
    formats = {r["suffix"]: r.asDict() for r in metrics.orderBy("suffix").collect()}
    failures = [f"{s}: {m['accuracy']:.2%}" for s, m in formats.items() if m["accuracy"] < ACCURACY.get(s, ACCURACY[""])]
    graph = {k: int(v) if isinstance(v, int) else float(v) for k, v in totals.first().asDict().items()}
    report = {"passed": not failures, "format_metrics": formats, "graph": graph, "failures": failures}
    head = ("suffix", "expected", "correct", "accuracy", "missing", "mismatched", "extra")
    lines = [f"# {'passed' if not failures else 'failed'}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join(f"{m[h]:.2%}" if h == "accuracy" else str(m[h]) for h in head) + " |" for m in formats.values()]
    lines += ["", *(f"- {k}: {v}" for k, v in graph.items()), *(f"- failed: {f}" for f in failures)]
    commits.put(spark, f"{folder}/report.json", json.dumps(report, ensure_ascii=False, indent=2).encode())
    commits.put(spark, f"{folder}/report.md", ("\n".join(lines) + "\n").encode())
    return report
