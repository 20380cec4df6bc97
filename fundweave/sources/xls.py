"""Cells of old binary workbooks (BIFF8 in a compound file) as text, with the standard library.

Sector chains of the compound file, small streams within its mini stream, shared strings over CONTINUE
records, numbers in all their packed forms, formulas by their stored result. Numbers are written as
they are stored, whole ones without a point; dates are numbers, as in the newer format's cells.
Encrypted workbooks and those before BIFF8 are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC, END, FREE = bytes.fromhex("d0cf11e0a1b11ae1"), 0xFFFFFFFE, 0xFFFFFFFF
#: Record kinds of the format.
BOF, EOF, CONTINUE, SHEET, SST, PASSWORD = 0x0809, 0x000A, 0x003C, 0x0085, 0x00FC, 0x002F
SHARED, LABEL, NUMBER, RK, MANY_RK, FORMULA, STRING, BOOL = 0x00FD, 0x0204, 0x0203, 0x027E, 0x00BD, 0x0006, 0x0207, 0x0205
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


class Broken(ValueError):
    pass


def stream(data: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """The first stream of these names."""
    if data[:8] != MAGIC:
        raise Broken("no compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, _, cutoff, first_small, _, more, _ = struct.unpack_from("<7I", data, 48)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    whole = lambda b: struct.unpack(f"<{len(b) // 4}I", b)
    tables, seen = list(struct.unpack_from("<109I", data, 76)), set()
    while more < END and more not in seen:
        seen.add(more)
        *part, more = whole(sector(more))
        tables += part
    fat = [x for k in tables if k < END for x in whole(sector(k))]

    def chain(k: int, links: list[int]) -> Iterator[int]:
        met = set()
        while k < END:
            if k in met or k >= len(links):
                raise Broken("a chain of sectors does not end")
            met.add(k)
            yield k
            k = links[k]

    read = lambda k: b"".join(sector(x) for x in chain(k, fat))
    entries = read(first_dir)
    listed = {}
    for at in range(0, len(entries), 128):
        n = struct.unpack_from("<H", entries, at + 64)[0]
        if n >= 2:
            name = entries[at : at + n - 2].decode("utf-16-le", "replace")
            listed[name] = entries[at + 66], *struct.unpack_from("<II", entries, at + 116)
    for name in names:
        if name in listed and listed[name][0] == 2:
            _, start, length = listed[name]
            if length >= cutoff:
                return read(start)[:length]
            held = read(next(s for kind, s, _ in listed.values() if kind == 5))
            links = list(whole(read(first_small)))
            return b"".join(held[k * small : (k + 1) * small] for k in chain(start, links))[:length]
    raise Broken("no workbook")


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(kind, its data and that of the CONTINUE records behind it)."""
    held = None
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        part, at = data[at + 4 : at + 4 + n], at + 4 + n
        if kind == CONTINUE and held:
            held[1].append(part)
            continue
        if held:
            yield held
        held = kind, [part]
        if kind == EOF:
            break
    if held:
        yield held


class Strings:
    """Strings in the parts of a record: characters that go on in the next part begin there with a new width."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.part, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            own = self.parts[self.part]
            if self.at >= len(own):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise Broken("a string does not end")
                continue
            more = own[self.at : self.at + n - len(out)]
            out, self.at = out + more, self.at + len(more)
        return out

    def next(self, wide_count: bool = True) -> str:
        n = struct.unpack("<H", self.take(2))[0] if wide_count else self.take(1)[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise Broken("a string does not end")
                wide = self.take(1)[0] & 1
            here = min(n, (len(self.parts[self.part]) - self.at) // (1 + wide))
            if not here:
                raise Broken("half a character")
            out.append(self.take(here * (1 + wide)).decode("utf-16-le", "surrogatepass") if wide else self.take(here).decode("latin-1"))
            n -= here
        self.take(4 * runs + extra)
        return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")  # halves of a pair meet


def said(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def packed(rk: int) -> float:
    """A number in 30 bits: an integer or the top of a double, perhaps in hundredths."""
    x = float((rk - (1 << 32) if rk >> 31 else rk) >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return x / 100 if rk & 1 else x


def _cells(data: bytes, at: int, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    open_ = None
    for kind, parts in records(data, at):
        d = parts[0]
        if kind == STRING and open_:
            yield *open_, Strings(parts).next()
        open_ = None
        if kind in (SHARED, LABEL, NUMBER, RK, MANY_RK, FORMULA, BOOL):
            row, column = struct.unpack_from("<HH", d)
            if kind == SHARED:
                yield row, column, shared[struct.unpack_from("<I", d, 6)[0]]
            elif kind == LABEL:
                yield row, column, Strings(parts, 6).next()
            elif kind == NUMBER:
                yield row, column, said(struct.unpack_from("<d", d, 6)[0])
            elif kind == RK:
                yield row, column, said(packed(struct.unpack_from("<I", d, 6)[0]))
            elif kind == MANY_RK:
                for k in range((len(d) - 6) // 6):
                    yield row, column + k, said(packed(struct.unpack_from("<I", d, 6 + 6 * k)[0]))
            elif kind == BOOL:
                yield row, column, ERRORS.get(d[6], "#ERR") if d[7] else str(d[6])
            elif d[12:14] == b"\xff\xff":  # a formula whose result is no number
                if d[6] == 0:
                    open_ = row, column
                elif d[6] in (1, 2):
                    yield row, column, str(d[8]) if d[6] == 1 else ERRORS.get(d[8], "#ERR")
            else:
                yield row, column, said(struct.unpack_from("<d", d, 6)[0])


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet; rows without cells are empty lists."""
    book = stream(data)
    places, shared = [], []
    for k, (kind, parts) in enumerate(records(book)):
        if k == 0 and (kind != BOF or struct.unpack_from("<H", parts[0])[0] != 0x0600):
            raise Broken("older than BIFF8")
        if kind == PASSWORD:
            raise Broken("encrypted")
        if kind == SHEET and parts[0][5] == 0:
            places.append((Strings([parts[0]], 6).next(False), struct.unpack_from("<I", parts[0])[0]))
        if kind == SST:
            held = Strings(parts, 8)
            shared = [held.next() for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
    for name, at in places:
        rows: list[list[str]] = []
        for row, column, text in sorted(_cells(book, at, shared)):
            rows += [[] for _ in range(row + 1 - len(rows))]
            rows[row] += [""] * (column + 1 - len(rows[row]))
            rows[row][column] = text
        yield name, rows
