"""The first sheet of spreadsheets of the older binary kind (.xls).

Such a file is a compound file, sectors linked to streams by tables, of which one stream holds the
workbook's records: shared strings, and the cells of each sheet.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Kinds of records, ends of sector chains and texts of errors in the format.
_BOF, _EOF, _BOUNDSHEET, _SST, _CONTINUE, _CODEPAGE, _FILEPASS = 0x0809, 0x000A, 0x0085, 0x00FC, 0x003C, 0x0042, 0x002F
_LABELSST, _LABEL, _RSTRING, _NUMBER, _RK, _MULRK, _FORMULA, _STRING, _BOOLERR = 0x00FD, 0x0204, 0x00D6, 0x0203, 0x027E, 0x00BD, 0x0006, 0x0207, 0x0205
_LAST_SECTOR = 0xFFFFFFFA
_ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def is_compound(content: bytes) -> bool:
    return content[:8] == MAGIC


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, content: bytes):
        self.content = content
        shift, mini_shift = struct.unpack_from("<HH", content, 30)
        first_directory, = struct.unpack_from("<I", content, 48)
        self.cutoff, first_mini, _, first_more, _ = struct.unpack_from("<5I", content, 56)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        tables = list(struct.unpack_from("<109I", content, 76))
        while first_more < _LAST_SECTOR:
            *further, first_more = struct.unpack(f"<{self.size // 4}I", self._sector(first_more))
            tables += further
        whole = b"".join(self._sector(k) for k in tables if k < _LAST_SECTOR)
        self.next = struct.unpack(f"<{len(whole) // 4}I", whole)
        self.mini_next = struct.unpack(f"<{len(mini) // 4}I", mini) if (mini := self._chain(first_mini)) else ()
        directory = self._chain(first_directory)
        self.entries = {}
        for at in range(0, len(directory), 128):
            length, kind = struct.unpack_from("<HB", directory, at + 64)
            if kind in (2, 5) and length >= 2:
                name = directory[at : at + length - 2].decode("utf-16-le", "replace")
                self.entries["" if kind == 5 else name] = struct.unpack_from("<II", directory, at + 116)

    def _sector(self, k: int) -> bytes:
        return self.content[(k + 1) * self.size : (k + 2) * self.size]

    def _chain(self, first: int) -> bytes:
        parts, seen = [], set()
        while first < _LAST_SECTOR and first not in seen:
            seen.add(first)
            parts.append(self._sector(first))
            first = self.next[first]
        return b"".join(parts)

    def stream(self, name: str) -> bytes:
        first, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(first)[:size]
        small, parts, seen = self._chain(self.entries[""][0]), [], set()
        while first < _LAST_SECTOR and first not in seen:
            seen.add(first)
            parts.append(small[first * self.mini_size : (first + 1) * self.mini_size])
            first = self.mini_next[first]
        return b"".join(parts)[:size]


def records(book: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """kind and data of the records from ``at`` on; those that continue one are its further parts."""
    kind, parts = None, []
    while at + 4 <= len(book):
        new, size = struct.unpack_from("<HH", book, at)
        data = book[at + 4 : at + 4 + size]
        at += 4 + size
        if new == _CONTINUE and kind is not None:
            parts.append(data)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = new, [data]
    if kind is not None:
        yield kind, parts


class _Parts:
    """Reads on through the parts of a record; characters that go on in a further part are told their width anew."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def more(self) -> bool:
        while self.part < len(self.parts) and self.at >= len(self.parts[self.part]):
            self.part, self.at = self.part + 1, 0
        return self.part < len(self.parts)

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.more():
            piece = self.parts[self.part][self.at : self.at + n - len(out)]
            self.at += len(piece)
            out += piece
        return out

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def text(self, n: int) -> str:
        """A string of ``n`` characters with its flags, formats and phonetic data."""
        flags = self.number("<B")
        runs = self.number("<H") if flags & 8 else 0
        extra = self.number("<I") if flags & 4 else 0
        out: list[str] = []
        wide, left = flags & 1, n
        while left and self.more():
            if out and self.at == 0 and self.part:
                wide = self.number("<B") & 1
            width = 2 if wide else 1
            piece = self.parts[self.part][self.at : self.at + left * width]
            if not piece:
                continue
            self.at += len(piece)
            out.append(piece.decode("utf-16-le" if wide else "latin-1", "replace"))
            left -= len(piece) // width
        self.take(4 * runs + extra)
        return "".join(out)


def _as_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _rk(raw: int) -> float:
    """A number in 30 bits: the upper half of a double, or a whole one, either perhaps in hundredths."""
    value = float(struct.unpack("<i", struct.pack("<I", raw))[0] >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def first_sheet(content: bytes) -> list[list[str | None]]:
    """The cells of the first worksheet, as text; empty ones are null, and so are rows' missing ends.

    Rows without cells are empty lists.  A workbook with a password raises ValueError.
    """
    file = Compound(content)
    name = next((n for n in ("Workbook", "Book") if n in file.entries), None)
    if name is None:
        raise ValueError("the file holds no workbook")
    book = file.stream(name)
    shared: list[str] = []
    start, modern, codepage = None, True, "cp1252"
    for kind, parts in records(book):
        if kind == _BOF and start is None:
            modern = struct.unpack_from("<H", parts[0])[0] >= 0x0600
        elif kind == _FILEPASS:
            raise ValueError("the workbook has a password")
        elif kind == _CODEPAGE:
            codepage = {1200: "utf-16-le", 32768: "mac_roman", 32769: "cp1252"}.get(n := struct.unpack("<H", parts[0])[0], f"cp{n}")
        elif kind == _BOUNDSHEET and start is None and parts[0][5] == 0:
            start, = struct.unpack_from("<I", parts[0])
        elif kind == _SST:
            reader = _Parts([parts[0][8:], *parts[1:]])
            while reader.more():
                shared.append(reader.text(reader.number("<H")))
        elif kind == _EOF:
            break
    if start is None:
        return []

    def written(parts: list[bytes], skip: int) -> str:
        reader = _Parts([parts[0][skip:], *parts[1:]])
        n = reader.number("<H")
        return reader.text(n) if modern else reader.take(n).decode(codepage, "replace")

    cells: dict[tuple[int, int], str] = {}
    waiting = None
    for kind, parts in records(book, start):
        data = parts[0]
        at = struct.unpack_from("<HH", data) if len(data) >= 4 else None
        if kind == _LABELSST:
            cells[at] = shared[struct.unpack_from("<I", data, 6)[0]]
        elif kind in (_LABEL, _RSTRING):
            cells[at] = written(parts, 6)
        elif kind == _NUMBER:
            cells[at] = _as_text(struct.unpack_from("<d", data, 6)[0])
        elif kind == _RK:
            cells[at] = _as_text(_rk(struct.unpack_from("<I", data, 6)[0]))
        elif kind == _MULRK:
            for k in range((len(data) - 6) // 6):
                cells[at[0], at[1] + k] = _as_text(_rk(struct.unpack_from("<I", data, 6 + 6 * k)[0]))
        elif kind == _BOOLERR:
            cells[at] = _ERRORS.get(data[6], "#ERR") if data[7] else str(data[6])
        elif kind == _FORMULA:
            if data[12:14] != b"\xff\xff":
                cells[at] = _as_text(struct.unpack_from("<d", data, 6)[0])
            elif data[6] == 0:
                waiting = at  # the text follows
            elif data[6] == 1:
                cells[at] = str(data[8])
            elif data[6] == 2:
                cells[at] = _ERRORS.get(data[8], "#ERR")
        elif kind == _STRING and waiting is not None:
            cells[waiting], waiting = written(parts, 0), None
        elif kind == _EOF:
            break
    rows: list[list[str | None]] = [[] for _ in range(1 + max((r for r, _ in cells), default=-1))]
    for (row, column), text in sorted(cells.items()):
        rows[row] += [None] * (column - len(rows[row])) + [text or None]
    return rows
