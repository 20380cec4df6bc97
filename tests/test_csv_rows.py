import csv
import io

import numpy as np
import pytest

from fundweave.sources import csv_rows


def texts():
    rng = np.random.default_rng(8)
    parts = ["a", "b c", "", '"', '""', ",", "\n", "\r\n", "é", "日本", "x" * 40]
    for k in range(14):
        if k % 2:  # any bytes that csv.reader takes
            yield "".join(rng.choice(parts, rng.integers(0, 120)))
            continue
        held = io.StringIO(newline="")
        w = csv.writer(held, lineterminator=["\n", "\r\n"][k // 2 % 2], quoting=[csv.QUOTE_MINIMAL, csv.QUOTE_ALL][k // 4 % 2])
        w.writerow(["h1", "h2", "h1"])
        for _ in range(int(rng.integers(0, 25))):
            w.writerow(["".join(rng.choice(parts, rng.integers(0, 8))) for _ in range(int(rng.integers(1, 5)))])
        yield ("﻿" if k % 4 else "") + held.getvalue()
    yield ""
    yield 'a,b\n1,"never\ncloses'
    yield "a,b\n\n1,2\n\n"


@pytest.mark.parametrize("size", [97, 1 << 27])
def test_equals_csv_reader_at_any_split(spark, tmp_path, size):
    want, wrong = {}, set()
    for k, text in enumerate(texts()):
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        try:
            rows = list(csv.reader(io.StringIO(text.removeprefix("﻿").removesuffix("\n"))))
        except csv.Error:
            wrong.add(f"{k}.csv")
            continue
        want |= {(f"{k}.csv", n): dict(zip(rows[0], r + [""] * (len(rows[0]) - len(r)))) for n, r in enumerate(rows[1:], 2) if r}
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = csv_rows.read_csv(spark, str(tmp_path)).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    found = {(r.path.rsplit("/", 1)[1], r.row_number): r.row_data for r in got if r.path.rsplit("/", 1)[1] not in wrong}
    assert found == want and len(got) >= len(found) > 100
    assert all(r.error is None for r in got if r.path.rsplit("/", 1)[1] not in wrong)


def test_a_cell_that_never_ends_is_one_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_rows, "MOST_CHARS", 100)
    (tmp_path / "a.csv").write_text('h\nok\n"' + "line\n" * 50)
    got = {r.row_number: (r.row_data, r.error) for r in csv_rows.read_csv(spark, str(tmp_path)).collect()}
    assert got[2] == ({"h": "ok"}, None) and got[3][0] is None and "does not end" in got[3][1] and len(got) == 2


def test_lines_equal_a_plain_scan():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        line = "".join(rng.choice(['"', ",", "a"], rng.integers(0, 9)))
        for inside in (False, True):
            rows = list(csv.reader(io.StringIO(('"' if inside else "") + line + "\nend")))
            assert csv_rows.inside_after(line, inside) == (len(rows) == 1), (line, inside)


def test_a_task_takes_a_few_rows_at_once():
    """Batches are read in small parts, whatever they hold."""
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"file": ["f"] * 1000, "start": [0] * 1000, "line": [str(k) for k in range(1000)]})
    parts = list(csv_rows._pieces(iter([b, b.slice(0, 3)])))
    assert max(p.num_rows for p in parts) <= csv_rows.PIECE and sum(p.num_rows for p in parts) == 1003
    assert [line for _, _, own in csv_rows._ranges(iter([b])) for line in own] == [str(k) for k in range(1000)]


def test_chunks_of_a_large_file_are_not_held(monkeypatch):
    from fundweave.sources import files

    alive, most = [0], [0]

    class Chunk(dict):
        def __init__(self, k):
            super().__init__(text=str(k))
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    def read(data):
        for k in range(int(data)):
            yield Chunk(k)
        if data.endswith(b" "):
            raise ValueError("broken")

    monkeypatch.setitem(files.READERS, ".csv", read)
    for n in (0, 1, files.BATCH, files.BATCH + 1, 7 * files.BATCH):
        count = 0
        for count, c in enumerate(files.chunks_of("a.csv", str(n).encode()), start=1):
            assert c["text"] == str(count - 1)
        assert count == n
    assert most[0] <= files.BATCH + 3
    assert [c["error"] for c in files.chunks_of("a.csv", f"{5 * files.BATCH} ".encode())] == ["ValueError: broken"]
