"""A case's folder: concurrent and broken-off changes, re-parsed sources, parts, versions as files."""

import csv
import hashlib
import io
import json
import threading
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fundweave.operators import dedup, reconcile
from fundweave.schema import RECORD_DDL
from fundweave.sources import commits, files, repository

DDL = f"seq long, {RECORD_DDL}"


def records(spark, rows):
    """rows: dictionaries of some fields; source: (file, row)."""
    names = [f.name for f in spark.createDataFrame([], DDL).schema]
    full = []
    for k, r in enumerate(rows):
        r = {"seq": k, "transaction_time": datetime(2026, 1, 1, 10), "payer_account": "1", "payee_account": "2", "payer_name": "", "payee_name": "", "currency": "CNY", "amount": Decimal("5.00"), "review_status": "pending", "review_note": "", "provenance": "rule_computed", "event_status": "success", **r}
        if isinstance(r.get("source"), tuple):
            r["source"] = (r["source"][0], None, None, "Sheet1", None, None, r["source"][1], None)
        full.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(full, DDL)


@pytest.mark.parametrize("threads,n,locked", [(8, 20, True), (3, 3, False)])
def test_concurrent_replacements_lose_nothing(spark, tmp_path, monkeypatch, threads, n, locked):
    """Also where nothing but the log keeps writers apart."""
    if not locked:
        monkeypatch.setattr(commits, "_LOCKS", defaultdict(nullcontext))
    folder = f"file://{tmp_path}/case"

    def replace(k):
        repository.replace_source(records(spark, [{"serial_number": f"S{k}", "source": (f"F{k}", 2)}]), folder, f"F{k}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(replace, range(n)))
    got = repository.list_drafts(spark, folder).collect()
    assert sorted(r.serial_number for r in got) == sorted(f"S{k}" for k in range(n)) and len({r.seq for r in got}) == n
    assert repository.list_audit(spark, folder).where("event = 'source_drafts_reconciled'").count() == n
    assert len({r.transaction_id for r in got}) == n and all(len(r.transaction_id) == 15 and r.transaction_id.startswith("TX-") for r in got)


def test_a_claim_has_one_winner(spark, tmp_path):
    gate, won = threading.Barrier(8), []

    def run(k):
        gate.wait()
        won.extend([k] * commits.claim(spark, f"file://{tmp_path}/log/1.json", str(k).encode()))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(run, range(8)))
    assert len(won) == 1 and (tmp_path / "log/1.json").read_text() == str(won[0]) and commits.names(spark, f"file://{tmp_path}/log") == ["1.json"]


def test_put_replaces(spark, tmp_path):
    for text in ("old and long", "new"):
        commits.put(spark, f"file://{tmp_path}/a.json", text.encode())
        assert commits.read(spark, f"file://{tmp_path}/a.json").decode() == text


class Killed(BaseException):
    pass


@pytest.mark.parametrize("kind", ["drafts", "version"])
def test_a_crash_between_any_two_steps_loses_nothing(spark, tmp_path, monkeypatch, kind):
    steps = ("_write", "move", "claim", "remove")
    first, k = records(spark, [{"serial_number": "A", "review_status": "confirmed"}]), 0
    while True:
        folder, left = f"file://{tmp_path}/{kind}{k}", [k]
        repository.add_drafts(first, folder)
        with monkeypatch.context() as m:
            for name in steps:
                def killing(*args, own=getattr(commits, name), **more):
                    for _ in range(2):  # before the step, then after it
                        if left[0] == 0:
                            raise Killed
                        left[0] -= 1
                        if _ == 0:
                            got = own(*args, **more)
                    return got
                m.setattr(commits, name, killing)
            try:
                repository.add_drafts(records(spark, [{"serial_number": "B"}]), folder) if kind == "drafts" else repository.create_version(spark, folder, "v")
                done = True
            except Killed:
                done = False
        serials = sorted(r.serial_number for r in repository.list_drafts(spark, folder).collect())
        if kind == "drafts":
            assert serials in (["A"], ["A", "B"])
            committed = len(serials)
            repository.add_drafts(records(spark, [{"serial_number": "C"}]), folder)
            assert repository.list_drafts(spark, folder).count() == committed + 1
            assert repository.list_audit(spark, folder).where("event = 'drafts_created'").count() == committed + 1
        else:
            had = repository.list_versions(spark, folder).count()
            for v in ("V001",) * had:
                path, _ = repository.download_version(spark, folder, v, "C")
                assert hashlib.sha256(commits.read(spark, path)).hexdigest() == repository.list_versions(spark, folder).first().sha256
            assert repository.create_version(spark, folder, "w")["version_id"] == f"V{had + 1:03d}"
        if done:
            break
        k += 1 if kind == "version" else 2
    assert k > 4


def test_rows_of_one_serial_keep_apart_by_their_coordinates(spark):
    """Two rows of a file with one serial; row 3 alone is read again. A null coordinate is no blank one."""
    old = records(spark, [{"transaction_id": f"T{r}", "serial_number": "S", "source": ("F", r), "review_note": f"note {r}", "review_status": "rejected"} for r in (2, 3)])
    new = records(spark, [{"transaction_id": "new", "serial_number": "S", "source": ("F", 3), "amount": Decimal("9.00")}])
    got = {r.transaction_id: (r.origin, r.review_note, r.amount) for r in reconcile.reconcile(old, new, "F", False).collect()}
    assert got == {"T3": ("updated", "note 3", Decimal("9.00")), "T2": ("leftover", "note 2", Decimal("5.00"))}
    flat = spark.createDataFrame([("F", None, "x", "", "a"), ("F", "x", None, "", "b"), ("F", None, None, "x", "c"), ("F", "", "x", "", "d")], "source_file_id string, archive_member_path string, sheet_name string, serial_number string, payer_account string")
    flat = flat.withColumns({"transaction_time": F.lit(None).cast("timestamp"), "payee_account": F.lit(None).cast("string"), "amount": F.lit(None).cast("decimal(18,2)")})
    assert flat.select(reconcile.identity(flat.columns).alias("i")).distinct().count() == 4


def test_sources_read_again(spark, tmp_path):
    """Replaced; kept where the reading failed in part; confirmed edits stay."""
    folder = f"file://{tmp_path}/case"
    row = lambda s, r, **more: {"serial_number": s, "source": ("F", r), **more}
    repository.add_drafts(records(spark, [{"serial_number": "OTHER", "source": ("G", 2)}]), folder)
    created = repository.replace_source(records(spark, [row("A", 2), row("B", 3)]), folder, "F").collect()
    assert len(created) == 2
    again = repository.replace_source(records(spark, [row("A", 2, amount=Decimal("7.00"))]), folder, "F").collect()
    assert [(r.serial_number, r.amount) for r in again] == [("A", Decimal("7.00"))] and again[0].transaction_id == next(r.transaction_id for r in created if r.serial_number == "A")
    assert sorted(r.serial_number for r in repository.list_drafts(spark, folder).collect()) == ["A", "OTHER"]
    repository.reconcile_source(records(spark, [row("C", 4)]), folder, "F", False)
    assert sorted(r.serial_number for r in repository.list_drafts(spark, folder).collect()) == ["A", "C", "OTHER"]
    edited = repository.update_draft(spark, folder, again[0].transaction_id, {"amount": Decimal("8.00"), "review_status": "confirmed", "summary": None}).first()
    assert (edited.amount, edited.provenance) == (Decimal("8.00"), "human_confirmed")
    repository.replace_source(records(spark, [row("A", 2), row("C", 4, review_note="x")]), folder, "F")
    got = {r.serial_number: (r.amount, r.review_status) for r in repository.list_drafts(spark, folder).collect()}
    assert got == {"A": (Decimal("8.00"), "confirmed"), "C": (Decimal("5.00"), "pending"), "OTHER": (Decimal("5.00"), "pending")}
    with pytest.raises(KeyError):
        repository.update_draft(spark, folder, "none", {"summary": "x"})
    assert repository.confirm_all(spark, folder) == 3 and repository.confirm_all(spark, folder) == 3
    assert {(r.review_status, r.review_note) for r in repository.list_drafts(spark, folder).collect()} == {("confirmed", ""), ("confirmed", "批量人工确认")}
    events = [(r.event, r["count"], r.replace_missing) for r in repository.list_audit(spark, folder).collect()]
    assert [e for e in events if e[0] == "source_drafts_reconciled"] == [("source_drafts_reconciled", n, m) for n, m in (("2", "True"), ("1", "True"), ("1", "False"), ("2", "True"))]
    assert sum(e[0] == "draft_updated" for e in events) == 3
    assert repository.clean(spark, folder, "drafts", keep=1) > 0 and repository.list_drafts(spark, folder).count() == 3


def test_parts_equal_a_full_mark(spark, tmp_path):
    """After edits duplicates and conflicts are those of all records, though only the parts touched were read."""
    import random

    rng, folder = random.Random(4), f"file://{tmp_path}/case"
    rows = [{"transaction_id": f"T{k}", "serial_number": rng.choice(["", "", *(f"S-{x}" for x in range(9)), "s3"]), "amount": Decimal(rng.choice(["1.00", "2.00"])), "source": (f"F{k % 3}", k)} for k in range(60)]
    repository.save_drafts(records(spark, rows), folder)
    for k in range(5):
        repository.update_draft(spark, folder, f"T{rng.randrange(60)}", {"amount": Decimal(rng.choice(["1.00", "2.00", "3.00"])), "payer_account": rng.choice(["1", "4"])})
    repository.add_drafts(records(spark, [{"transaction_id": "new", "serial_number": "S 3"}]), folder)
    assert len(commits.latest(spark, f"{folder}/drafts/log")[1]["read_parts"]) == 1
    repository.replace_source(records(spark, rows[:60:6]), folder, "F0")
    got = repository.list_drafts(spark, folder)
    key = ("transaction_id", "duplicate_group", "conflict_status")
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, dedup.mark(got).select(*key).collect()))
    assert got.count() == 51 and got.where("duplicate_group is not null").count() > 5 and got.where("conflict_status is not null").count() > 5
    repository.export_drafts(spark, folder, f"{folder}/lines")
    assert files.read_drafts(spark, f"{folder}/lines").count() == 51


def test_drafts_are_dealt_once_and_confirmed_in_place(spark, tmp_path, monkeypatch):
    """Marking and writing share one shuffle, confirming needs none; families too large for a window get the same marks by joins."""
    import random

    rng, key = random.Random(5), ("transaction_id", "duplicate_group", "conflict_status")
    rows = records(spark, [{"transaction_id": f"T{k}", "serial_number": rng.choice(["", None, *(f"S-{x}" for x in range(20)), "s3", *["hot"] * 9]), "amount": Decimal(rng.choice(["1.00", "2.00"])), "payer_account": rng.choice(["1", "2", None]), "source": ("F", k)} for k in range(90)])
    full = sorted(map(str, dedup.mark(rows).select(*key).collect()))
    for busy in (repository.BUSY, 4):
        monkeypatch.setattr(repository, "BUSY", busy)
        got = repository._marked(rows, 4)
        if busy > 90:
            assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(map(str, got.select(*key).collect())) == full
    folder = f"file://{tmp_path}/case"
    repository.save_drafts(rows, folder)
    monkeypatch.setattr(repository, "_marked", None)
    assert repository.confirm_all(spark, folder) == 90
    done = repository.list_drafts(spark, folder)
    assert {(r.review_status, r.provenance) for r in done.collect()} == {("confirmed", "human_confirmed")} and sorted(map(str, done.select(*key).collect())) == full


def test_version_bytes(spark, tmp_path):
    """Equal to a csv and json writer that is given all fields of each record, nulls and blank lists too."""
    folder = f"file://{tmp_path}/case"
    odd = [
        {"serial_number": "S1", "summary": 'a "quoted", line\nand\r\nmore', "amount": Decimal("1234567.50"), "fee": Decimal("0.05"), "confidence": {"amount": 0.5, "名": 1.0}, "source": ("F", 2)},
        {"serial_number": "S2", "summary": " é中", "amount": Decimal("10000000.00"), "transaction_time": datetime(2026, 1, 2, 3, 4, 5, 60), "balance_after": Decimal("-0.10"), "source": Row("F", None, 1, None, None, None, None, [0.0, 0.0, 12.5, 3.0])},
        {"serial_number": "S3", "amount": Decimal("0.01"), "confidence": {}, "source": Row(*[None] * 8), "evidence_locations": []},
    ]
    made = records(spark, [{**r, "transaction_id": f"T{k}", "review_status": "confirmed"} for k, r in enumerate(odd)])
    repository.add_drafts(made, folder)
    repository.add_drafts(made.where("seq = 0").withColumn("transaction_id", F.lit("copy")), folder)
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda n: repository.create_version(spark, folder, n), "ab"))
    assert sorted(v["version_id"] for v in got) == ["V001", "V002"] and [r.version_id for r in repository.list_versions(spark, folder).collect()] == ["V001", "V002"]
    kept = sorted((r for r in repository.list_drafts(spark, folder).collect() if r.transaction_id != "copy"), key=lambda r: r.seq)
    names = [f for f in kept[0].__fields__ if f != "seq"]
    plain = lambda x: x.asDict() if isinstance(x, Row) else x
    held = io.StringIO(newline="")
    out = csv.DictWriter(held, names)
    out.writeheader()
    for r in kept:
        row = {n: float(v) if isinstance(v, Decimal) else v.isoformat() if isinstance(v, datetime) else v for n, v in zip(r.__fields__, r, strict=True) if n != "seq"}
        row["source"], row["evidence_locations"], row["confidence"] = (json.dumps(x, ensure_ascii=False) for x in (plain(r.source), [plain(e) for e in r.evidence_locations], r.confidence or {}))
        out.writerow(row)
    path, name = repository.download_version(spark, folder, "V001", "CASE-1")
    data = (tmp_path / "case/versions/V001.csv").read_bytes()
    assert path.endswith("versions/V001.csv") and name == "CASE-1-V001-confirmed.csv"
    assert data == held.getvalue().encode("utf-8-sig")
    assert {v["sha256"] for v in got} == {hashlib.sha256(data).hexdigest()}
    back = repository.read_version(spark, folder, "V002").orderBy("transaction_id").collect()
    assert [r.amount for r in back] == [r.amount for r in kept] and [r.source for r in back] == [r.source for r in kept] and [r.transaction_time for r in back] == [r.transaction_time for r in kept]
    with pytest.raises(KeyError):
        repository.download_version(spark, folder, "V003", "CASE-1")


def test_cases_and_materials(spark, tmp_path):
    folder = f"file://{tmp_path}/all"
    cases = spark.createDataFrame([("a", "A", "active", 1.0, "2026-01-01"), ("b", "B", "active", 2.0, "2026-01-02")], repository.CASE_DDL)
    repository.save_cases(cases, folder)
    repository.save_cases(repository.set_status(repository.list_cases(spark, folder), "b", "archived"), folder)
    assert [(r.case_id, r.status) for r in repository.list_cases(spark, folder).collect()] == [("b", "archived"), ("a", "active")]
    repository.save_cases(repository.set_status(repository.list_cases(spark, folder), "b", "whatever"), folder)
    assert {r.status for r in repository.list_cases(spark, folder).collect()} == {"active"}
    repository.save_materials(spark.createDataFrame([("m", "f.csv", "parsed", "00")], repository.MATERIAL_DDL), folder)
    assert repository.list_materials(spark, folder).count() == 1
    seen = spark.createDataFrame([(2, "x"), (1, "y"), (3, "x"), (4, "y")], "seq long, warning string")
    assert [r[0] for r in repository.first_seen(seen, "warning").collect()] == ["y", "x"]


def plain_depths(edges):
    """Roots without incoming edges by id, then what they do not reach, by id."""
    ids = sorted({n for e in edges for n in e})
    depth = {}

    def walk(starts):
        queue = list(starts)
        for n in queue:
            for s, t in edges:
                if s == n and t not in depth:
                    depth[t] = depth[n] + 1
                    queue.append(t)

    roots = [n for n in ids if all(t != n for _, t in edges)]
    depth.update(dict.fromkeys(roots, 0))
    walk(roots)
    for n in ids:
        if n not in depth:
            depth[n] = 0
            walk([n])
    return depth


@pytest.mark.parametrize("seed", range(3))
def test_depths_of_graphs_with_cycles(spark, seed):
    """Cycles that no root reaches, chained cycles, self-loops and trees; more steps than one job takes."""
    import random

    from fundweave.operators import layout

    rng = random.Random(seed)
    edges = {(f"r{rng.randrange(25):02d}", f"r{rng.randrange(25):02d}") for _ in range(28)}
    edges |= {(f"c{k:02d}", f"c{(k + 1) % 30:02d}") for k in range(30)} | {("z1", "z2"), ("z2", "z1"), ("z2", "b1"), ("b1", "b2"), ("b2", "b1"), ("s", "s")}
    edges |= {(f"a{k:02d}", f"a{k + 1:02d}") for k in range(14)}
    edges = sorted(edges)
    got = {r.node: r.depth for r in layout.depths(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert got == plain_depths(edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from fundweave.operators import layout

    calls, own = [], layout.places
    monkeypatch.setattr(layout, "places", lambda *a: calls.append(1) or own(*a))
    n = 5000
    rows = spark.createDataFrame([(f"{(k * 7919) % n:05d}", f"{((k - 1) * 7919) % n:05d}" if k else None, k) for k in range(n)] + [("x", f"{0:05d}", 1)], "node string, parent string, depth int")
    got = {r.node: r["rank"] for r in layout.path_ranks(rows).collect()}
    assert len(got) == n + 1 and len(calls) == 14 and got["x"] > got[f"{7919 % n:05d}"]
