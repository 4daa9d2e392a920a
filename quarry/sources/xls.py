"""Cells of .xls workbooks: the compound file's Workbook stream, and in it the records of sheets, strings and numbers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA
# Numbers of records.
BOUNDSHEET, SST, CONTINUE, EOF, BOF, LABEL, LABELSST, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR, DATE1904, XF, FORMAT, CODEPAGE = 0x85, 0xFC, 0x3C, 0x0A, 0x809, 0x204, 0xFD, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205, 0x22, 0xE0, 0x41E, 0x42


def workbook_stream(content: bytes) -> bytes:
    """The Workbook (or Book) stream of a compound file."""
    if not content.startswith(MAGIC):
        raise ValueError("no compound file")
    size, mini = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    n_fat, first_dir, _, cutoff, first_mini = struct.unpack_from("<I", content, 44)[0], *struct.unpack_from("<IIII", content, 48)
    sector = lambda i: content[size * (i + 1) : size * (i + 2)]
    words = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw))
    # where the allocation table stands: 109 places in the header, more in a chain of its own
    places = words(content[76:512])
    more, n_more = struct.unpack_from("<II", content, 68)
    for _ in range(n_more):
        if more >= _END:
            break
        *own, more = words(sector(more))
        places += own
    fat = [x for p in places[:n_fat] if p < _END for x in words(sector(p))]

    def chain(first: int, table: list[int]) -> list[int]:
        out, seen = [], set()
        while first < _END:
            if first >= len(table) or first in seen:
                raise ValueError("broken chain of sectors")
            seen.add(first)
            out.append(first)
            first = table[first]
        return out

    read = lambda first: b"".join(map(sector, chain(first, fat)))
    entries = read(first_dir)
    root = None
    for at in range(0, len(entries), 128):
        n = struct.unpack_from("<H", entries, at + 64)[0]
        name = entries[at : at + max(0, n - 2)].decode("utf-16-le", "replace")
        first, length = struct.unpack_from("<II", entries, at + 116)
        if entries[at + 66] == 5:
            root = first
        elif entries[at + 66] == 2 and name.lower() in ("workbook", "book"):
            if length >= cutoff:
                return read(first)[:length]
            small = read(root)
            table = words(read(first_mini))
            return b"".join(small[mini * i : mini * (i + 1)] for i in chain(first, table))[:length]
    raise ValueError("no workbook in the file")


def records(stream: bytes, at: int = 0):
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        yield kind, at, stream[at + 4 : at + 4 + n]
        at += 4 + n


class _Strings:
    """Strings of records that go on in others; a string cut by a record's end begins there with its width again."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.i, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.i < len(self.parts):
            x = self.parts[self.i][self.at : self.at + n - len(out)]
            out, self.at = out + x, self.at + len(x)
            if self.at >= len(self.parts[self.i]) and len(out) < n:
                self.i, self.at = self.i + 1, 0
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        text, wide, have = [], flags & 1, 0  # n counts units of two bytes, of which some characters have two
        while have < n:
            if self.at >= len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 0
                if self.i >= len(self.parts):
                    break
                wide = self.take(1)[0] & 1
            here = (len(self.parts[self.i]) - self.at) // (2 if wide else 1)
            raw = self.take(min(here, n - have) * (2 if wide else 1))
            if not raw:
                break
            have += len(raw) // (2 if wide else 1)
            text.append(raw if wide else raw.decode("latin-1").encode("utf-16-le"))
        self.take(4 * runs + extra)
        return b"".join(text).decode("utf-16-le", "replace")


def _rk(x: int) -> float:
    value = float((x & 0xFFFFFFFF) >> 2 if not x & 0x80000000 else ((x & 0xFFFFFFFF) >> 2) - (1 << 30)) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return value / 100 if x & 1 else value


def _short(raw: bytes, at: int, wide_count: bool = True) -> str:
    n = struct.unpack_from("<H" if wide_count else "<B", raw, at)[0]
    at += 2 if wide_count else 1
    wide = raw[at] & 1
    return raw[at + 1 : at + 1 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")


def sheets(content: bytes, number) -> list[list[dict[int, str]]]:
    """Rows of each sheet as {column: text}; ``number(value, format, day 0 is in 1904)`` shows a number."""
    return list(each_sheet(content, number))


def each_sheet(content: bytes, number) -> Iterator[list[dict[int, str]]]:
    """The same, one sheet at a time."""
    stream = workbook_stream(content)
    shared: list[str] = []
    starts: list[int] = []
    styles: list[int] = []
    formats: dict[int, str] = {}
    late = False
    open_: list[bytes] | None = None
    for kind, _, raw in records(stream):
        if kind == CONTINUE and open_ is not None:
            open_.append(raw)
            continue
        if open_:
            s = _Strings(open_)
            shared = [s.string() for _ in range(struct.unpack("<II", s.take(8))[1])]
        open_ = [raw] if kind == SST else None
        if kind == BOUNDSHEET and raw[5] == 0:
            starts.append(struct.unpack_from("<I", raw)[0])
        elif kind == DATE1904:
            late = bool(struct.unpack_from("<H", raw)[0])
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", raw)[0]] = _short(raw, 2)
        elif kind == XF:
            styles.append(struct.unpack_from("<H", raw, 2)[0])
        elif kind == EOF:
            break

    def shown(value: float, style: int) -> str:
        f = styles[style] if style < len(styles) else 0
        return number(value, f, formats.get(f, ""), late)

    for start in starts:
        cells: dict[int, dict[int, str]] = {}
        waits = None
        for kind, at, raw in records(stream, start):
            if kind == EOF and at > start:
                break
            if kind == STRING and waits:
                cells[waits[0]][waits[1]] = _short(raw, 0)
                waits = None
            if kind in (LABEL, LABELSST, NUMBER, RK, FORMULA, BOOLERR):
                r, c, style = struct.unpack_from("<HHH", raw)
                row = cells.setdefault(r, {})
                if kind == LABEL:
                    row[c] = _short(raw, 6)
                elif kind == LABELSST:
                    row[c] = shared[struct.unpack_from("<I", raw, 6)[0]]
                elif kind == NUMBER:
                    row[c] = shown(struct.unpack_from("<d", raw, 6)[0], style)
                elif kind == RK:
                    row[c] = shown(_rk(struct.unpack_from("<I", raw, 6)[0]), style)
                elif kind == BOOLERR:
                    row[c] = str(bool(raw[6])) if not raw[7] else ""
                elif raw[12:14] != b"\xff\xff":
                    row[c] = shown(struct.unpack_from("<d", raw, 6)[0], style)
                elif raw[6] == 0:
                    waits = (r, c)
                elif raw[6] == 1:
                    row[c] = str(bool(raw[8]))
            elif kind == MULRK:
                r, first = struct.unpack_from("<HH", raw)
                for i in range((len(raw) - 6) // 6):
                    style, x = struct.unpack_from("<HI", raw, 4 + 6 * i)
                    cells.setdefault(r, {})[first + i] = shown(_rk(x), style)
        yield [cells[r] for r in sorted(cells)]
