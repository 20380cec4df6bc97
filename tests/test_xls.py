import struct

import pytest

from fundweave.sources import files, xls


def compound(book: bytes, small: bool) -> bytes:
    """A compound file with one stream, in sectors or in the mini stream."""
    fat, sectors = [], []

    def put(data: bytes) -> int:
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        fat.extend([first + k + 1 for k in range(len(parts) - 1)] + [xls.END])
        sectors.extend(parts)
        return first

    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB12s36xIII", 2 * len(name) + 2, kind, 1, b"\xff" * 12, start, size, 0)
    cutoff, first_small, n = 4096, xls.END, -(-len(book) // 64)
    if small:
        first_small = put(b"".join(struct.pack("<I", k + 1 if k < n - 1 else xls.END) for k in range(n)).ljust(512, b"\xff"))
        root, own = put(book.ljust(64 * n, b"\0")), 0
        folder = entry("Root Entry", 5, root, 64 * n)
    else:
        book = book.ljust(cutoff, b"\0")
        own = put(book)
        folder = entry("Root Entry", 5, xls.END, 0)
    at = put((folder + entry("Workbook", 2, own, len(book))).ljust(512, b"\0"))
    tables = -(-(len(sectors) + 2) // 127)
    table = b"".join(struct.pack("<I", x) for x in fat + [0xFFFFFFFD] * tables).ljust(512 * tables, b"\xff")
    places = list(range(len(sectors), len(sectors) + tables))
    head = xls.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<8I", tables, at, 0, cutoff, first_small, 1, xls.END, 0)
    return head + b"".join(struct.pack("<I", k) for k in places).ljust(436, b"\xff") + b"".join(sectors) + table


def record(kind: int, data: bytes) -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def workbook(cells: bytes, strings: list[str], cut: int, rich: bool = False) -> bytes:
    """A sheet with these cell records. Shared strings are cut into CONTINUE records of `cut` bytes, within characters' strings too."""
    parts, own = [], struct.pack("<II", len(strings), len(strings))
    for text in strings:
        wide = any(ord(c) > 255 for c in text)
        units = text.encode("utf-16-le") if wide else text.encode("latin-1")
        own += struct.pack("<HB", len(units) // (1 + wide), wide | 8 * rich) + (struct.pack("<H", 1) if rich else b"")
        while units:
            room = max(0, cut - len(own)) // (1 + wide) * (1 + wide)
            own, units = own + units[:room], units[room:]
            if units:
                parts.append(own)
                own = bytes([wide])
        own += b"\0" * 4 * rich
        if len(own) >= cut:
            parts, own = [*parts, own], b""
    parts.append(own)
    table = record(xls.SST, parts[0]) + b"".join(record(xls.CONTINUE, p) for p in parts[1:])
    start = record(xls.BOF, struct.pack("<HHHHII", 0x0600, 5, 0, 0, 0, 0))
    name = "明细".encode("utf-16-le")
    after = len(start) + 4 + 6 + 2 + len(name) + len(table) + 4
    sheet = record(xls.SHEET, struct.pack("<IBB", after, 0, 0) + struct.pack("<BB", 2, 1) + name)
    return start + sheet + table + record(xls.EOF, b"") + record(xls.BOF, struct.pack("<HHHHII", 0x0600, 16, 0, 0, 0, 0)) + cells + record(xls.EOF, b"")


STRINGS = ["账号", "name", "0012345678901234567", "é" * 70, "日本😀" * 40, ""]


@pytest.mark.parametrize("small,cut,rich", [(True, 8000, False), (True, 40, False), (False, 61, True), (False, 8000, True)])
def test_cells(small, cut, rich):
    at = lambda r, c: struct.pack("<HHH", r, c, 0)
    cells = b"".join(record(xls.SHARED, at(0, c) + struct.pack("<I", c)) for c in range(2))
    cells += record(xls.SHARED, at(1, 0) + struct.pack("<I", 2)) + record(xls.NUMBER, at(1, 1) + struct.pack("<d", 12.5))
    cells += record(xls.SHARED, at(3, 0) + struct.pack("<I", 3)) + record(xls.SHARED, at(3, 1) + struct.pack("<I", 4))
    rk = lambda whole, hundredths: struct.pack("<I", (whole << 2 & 0xFFFFFFFF) | 2 | hundredths)
    cells += record(xls.RK, at(4, 0) + rk(-7, 0)) + record(xls.RK, at(4, 1) + rk(1234, 1))
    cells += record(xls.MANY_RK, struct.pack("<HH", 5, 0) + b"\0\0" + rk(5, 0) + b"\0\0" + struct.pack("<I", struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32) + struct.pack("<H", 1))
    cells += record(xls.FORMULA, at(6, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(xls.STRING, struct.pack("<HB", 2, 0) + b"ok") + record(xls.FORMULA, at(6, 1) + struct.pack("<d", 3.0) + b"\0" * 8)
    cells += record(xls.BOOL, at(7, 0) + b"\1\0") + record(xls.BOOL, at(7, 1) + b"\x07\1") + record(xls.LABEL, at(8, 0) + struct.pack("<HB", 3, 0) + b"old")
    data = compound(workbook(cells, STRINGS, cut, rich), small)
    rows = [["账号", "name"], [STRINGS[2], "12.5"], [], [STRINGS[3], STRINGS[4]], ["-7", "12.34"], ["5", "1.5"], ["ok", "3"], ["1", "#DIV/0!"], ["old"]]
    assert list(xls.sheets(data)) == [("明细", rows)]
    got = list(files.chunks_of("a.xls", data))
    assert [(c["sheet_name"], c["row_number"], c["row_data"]) for c in got] == [("明细", n, dict(zip(rows[0], r + [""] * (2 - len(r))))) for n, r in enumerate(rows[1:], 2) if r]


@pytest.mark.parametrize("data", [b"", xls.MAGIC, xls.MAGIC + b"\0" * 600, compound(workbook(b"", STRINGS, 8000), True)[:900], compound(record(xls.BOF, struct.pack("<HH", 0x0500, 5)) + record(xls.EOF, b""), True), compound(record(xls.BOF, struct.pack("<HH", 0x0600, 5)) + record(xls.PASSWORD, b"\0\0") + record(xls.EOF, b""), True)])
def test_broken_files_are_one_error_row(data):
    got = list(files.chunks_of("a.xls", data))
    assert len(got) == 1 and got[0]["error"]
