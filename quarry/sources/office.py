"""The smallest workbooks and zip-based files that readers take, as bytes."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterable


def archive(parts: dict[str, str | Iterable[str]]) -> bytes:
    """A part that is given in pieces is packed as they come, and never whole."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            info = zipfile.ZipInfo(name)
            if isinstance(text, str):
                z.writestr(info, text)
                continue
            info.compress_type = zipfile.ZIP_DEFLATED
            with z.open(info, "w", force_zip64=True) as part:
                for piece in text:
                    part.write(piece.encode())
    return out.getvalue()


#: Rows of an old workbook's sheet, and bytes of a record.
SHEET_ROWS, RECORD = 65_536, 8_224
_SECTOR, _FREE, _LAST, _FAT, _MORE = 512, 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC


def _record(kind: int, raw: bytes) -> bytes:
    return struct.pack("<HH", kind, len(raw)) + raw


def _shared(strings: list[str], n: int) -> bytes:
    """The table of strings, each used string once; what a record can't hold goes on in others, a string that is cut with its width again."""
    parts = [bytearray(struct.pack("<II", n, len(strings)))]
    for s in strings:
        raw, at = s.encode("utf-16-le"), 0
        if len(parts[-1]) + 3 > RECORD:
            parts.append(bytearray())
        parts[-1] += struct.pack("<HB", len(raw) // 2, 1)
        while at < len(raw):
            if (room := (RECORD - len(parts[-1])) // 2 * 2) <= 0:
                parts.append(bytearray(b"\1"))
                continue
            parts[-1] += raw[at : at + room]
            at += room
    return b"".join(_record(0x3C if i else 0xFC, bytes(x)) for i, x in enumerate(parts))


def _compound(stream: bytes) -> bytes:
    """A compound file of one stream: the stream, its folder, the allocation table, and that table's places beyond the 109 of the header."""
    stream += bytes(max(0, 4096 - len(stream)))
    n = -(-len(stream) // _SECTOR)
    n_fat = n_more = 0
    while n_fat * 128 < n + 1 + n_fat + n_more or n_more * 127 < n_fat - 109:
        n_fat += 1
        n_more = -(-max(0, n_fat - 109) // 127)
    first = n + 1  # of the table, behind the stream and the folder
    fat = [*range(1, n), _LAST, _LAST, *[_FAT] * n_fat, *[_MORE] * n_more]
    places = list(range(first, first + n_fat))
    more = b""
    for k in range(n_more):
        own = places[109 + 127 * k : 109 + 127 * (k + 1)]
        more += struct.pack("<128I", *own, *[_FREE] * (127 - len(own)), first + n_fat + k + 1 if k + 1 < n_more else _LAST)
    entry = lambda name, kind, first, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2 if name else 0, kind, 1) + struct.pack("<III", *[_FREE] * 3) + bytes(36) + struct.pack("<III", first, size, 0)
    folder = entry("Root Entry", 5, _LAST, 0) + entry("Workbook", 2, 0, len(stream)) + entry("", 0, 0, 0) * 2
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, n, 0, 4096, _LAST, 0, first + n_fat if n_more else _LAST, n_more)
    head += struct.pack("<109I", *places[:109], *[_FREE] * (109 - len(places[:109])))
    return head + stream + bytes(-len(stream) % _SECTOR) + folder + struct.pack(f"<{128 * n_fat}I", *fat, *[_FREE] * (128 * n_fat - len(fat))) + more


def xls(cells: Iterable[tuple], header: int = 0) -> bytes:
    """A workbook of (row, column, string or number), the header's first, in the smallest form that readers take.

    A sheet has ``SHEET_ROWS`` rows; what is below goes on in further sheets, each under the first ``header`` rows again.
    """
    strings: dict[str, int] = {}
    top, room, n = [], SHEET_ROWS - header, 0
    sheets: dict[int, bytearray] = {}

    def put(k: int, r: int, c: int, v) -> None:
        if isinstance(v, str):
            raw = _record(0xFD, struct.pack("<HHHI", r, c, 0, strings.setdefault(v, len(strings))))
        elif isinstance(v, int) and -(1 << 29) <= v < 1 << 29:
            raw = _record(0x27E, struct.pack("<HHHI", r, c, 0, ((v << 2) | 2) & 0xFFFFFFFF))
        else:
            raw = _record(0x203, struct.pack("<HHHd", r, c, 0 if isinstance(v, int) else 1, v))
        sheets[k] += raw

    for r, c, v in cells:
        k, below = (0, r) if r < header else divmod(r - header, room)
        n += isinstance(v, str)
        if r < header:
            top.append((r, c, v))
        if k not in sheets:
            sheets[k] = bytearray()
            for x in top if k else ():
                put(k, *x)
        put(k, r if r < header else below + header, c, v)
    bof, eof = _record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0)), _record(0x0A, b"")
    xf = _record(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + _record(0xE0, struct.pack("<HH", 0, 14) + bytes(16))
    made = [bof + sheets.pop(k) + eof for k in sorted(sheets)] or [bof + eof]
    names = [f"S{k}".encode() for k in range(1, len(made) + 1)]
    sst = _shared(list(strings), n)
    at, places = len(bof) + len(xf) + len(sst) + sum(4 + 8 + len(x) for x in names) + len(eof), b""
    for name, x in zip(names, made, strict=True):
        places += _record(0x85, struct.pack("<IBBBB", at, 0, 0, len(name), 0) + name)
        at += len(x)
    return _compound(bof + xf + sst + places + eof + b"".join(made))
