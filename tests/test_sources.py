"""Binary spreadsheets and servers that hand rows out in pages."""

from __future__ import annotations

import json
import random
import struct
import zipfile
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock, Thread
from urllib.parse import parse_qs, urlparse

import pytest

from sievelight.sources import http_pages, readers, xls


def record(kind, data):
    return struct.pack("<HH", kind, len(data)) + data


def shared_strings(texts, most=8224, seed=0):
    """The record of shared strings with its continuations; parts are cut within characters' runs, where the width may change."""
    rng = random.Random(seed)
    parts, now = [], bytearray(struct.pack("<II", len(texts), len(texts)))

    def room():
        return most - len(now)

    for k, text in enumerate(texts):
        rich, extra = (3, b"\1\2\3\4" * 3) if k % 5 == 1 else (0, b""), b"phonetic" if k % 7 == 2 else b""
        runs, run_data = rich
        wide = any(ord(c) > 255 for c in text)
        head = struct.pack("<HB", len(text), wide | (8 if runs else 0) | (4 if extra else 0))
        head += (struct.pack("<H", runs) if runs else b"") + (struct.pack("<I", len(extra)) if extra else b"")
        if room() < len(head) + 2:
            parts.append(bytes(now))
            now = bytearray()
        now += head
        left = text
        while left:
            n = min(len(left), room() // (2 if wide else 1))
            now += left[:n].encode("utf-16-le" if wide else "latin-1")
            left = left[n:]
            if left:
                parts.append(bytes(now))
                wide = any(ord(c) > 255 for c in left) or rng.random() < 0.5
                now = bytearray([wide])
        for data in (run_data, extra):
            while data:
                if not room():
                    parts.append(bytes(now))
                    now = bytearray()
                now += data[: (n := room())]
                data = data[n:]
    parts.append(bytes(now))
    return record(0xFC, parts[0]) + b"".join(record(0x3C, p) for p in parts[1:])


def workbook(rows, most=8224):
    """Records of a book whose second sheet is the first worksheet; cells are (kind, value) or text."""
    texts = list(dict.fromkeys(c for row in rows for c in row if isinstance(c, str)))
    cells = b""
    for r, row in enumerate(rows):
        for c, cell in enumerate(row):
            at = struct.pack("<HHH", r, c, 0)
            if isinstance(cell, str):
                cells += record(0xFD, at + struct.pack("<I", texts.index(cell)))
            elif isinstance(cell, float):
                cells += record(0x203, at + struct.pack("<d", cell))
            elif isinstance(cell, int):
                cells += record(0x27E, at + struct.pack("<I", (cell << 2 | 2) & 0xFFFFFFFF))
            elif cell is not None:
                kind, value = cell
                if kind == "label":
                    cells += record(0x204, at + struct.pack("<HB", len(value), 1) + value.encode("utf-16-le"))
                elif kind == "many":
                    body = b"".join(struct.pack("<HI", 0, (v * 100) << 2 & 0xFFFFFFFF | 3) for v in value)
                    cells += record(0xBD, struct.pack("<HH", r, c) + body + struct.pack("<H", c + len(value) - 1))
                elif kind == "formula":
                    result = b"\0" * 6 + b"\xff\xff" if isinstance(value, str) else struct.pack("<d", value)
                    cells += record(0x6, at + result + b"\0" * 8)
                    if isinstance(value, str):
                        cells += record(0x207, struct.pack("<HB", len(value), 0) + value.encode("latin-1"))
                elif kind == "bool":
                    cells += record(0x205, at + bytes([value, 0]))
                elif kind == "error":
                    cells += record(0x205, at + bytes([value, 1]))
    sheet = record(0x809, struct.pack("<HH", 0x600, 0x10) + b"\0" * 12) + cells + record(0xA, b"")
    chart = record(0x809, struct.pack("<HH", 0x600, 0x20) + b"\0" * 12) + record(0xA, b"")
    head = record(0x809, struct.pack("<HH", 0x600, 0x5) + b"\0" * 12) + record(0x42, struct.pack("<H", 1200))
    strings = shared_strings(texts, most)
    sheets = lambda a, b: b"".join(record(0x85, struct.pack("<IBBBB", o, 0, kind, 2, 0) + n) for o, kind, n in ((a, 2, b"ch"), (b, 0, b"sh")))
    start = len(head + sheets(0, 0) + strings + record(0xA, b""))
    return head + sheets(start, start + len(chart)) + strings + record(0xA, b"") + chart + sheet


def compound(book, seed=1):
    """A compound file of one stream whose sectors lie in any order; small streams go to the small sectors."""
    rng = random.Random(seed)
    small = len(book) < 4096
    pad = lambda b, n: b + b"\0" * (-len(b) % n)
    data, mini_table = pad(book, 512), b""
    if small:
        n = -(-len(book) // 64)
        mini_table = pad(struct.pack(f"<{n}I", *range(1, n), 0xFFFFFFFE), 512)
        data = pad(pad(book, 64), 512)
    chains = {"data": data, "directory": b"", "mini": mini_table}
    count = {"data": len(data) // 512, "directory": 1, "mini": len(mini_table) // 512}
    total = sum(count.values())
    tables = 1
    while (total + tables) > tables * 128:
        tables += 1
    order = list(range(total + tables))
    rng.shuffle(order)
    places, at = {}, 0
    for name, n in count.items():
        places[name], at = order[at : at + n], at + n
    table_places = order[at:]
    table = [0xFFFFFFFF] * (tables * 128)
    for found in places.values():
        for a, b in zip(found, [*found[1:], 0xFFFFFFFE]):
            table[a] = b
    for k in table_places:
        table[k] = 0xFFFFFFFD

    def entry(name, kind, first, size):
        text = name.encode("utf-16-le") + b"\0\0"
        return text.ljust(64, b"\0") + struct.pack("<HBB", len(text), kind, 1) + struct.pack("<3I", *[0xFFFFFFFF] * 3) + b"\0" * 36 + struct.pack("<IQ", first, size)

    first = places["data"][0]
    root = entry("Root Entry", 5, first if small else 0xFFFFFFFE, len(data) if small else 0)
    chains["directory"] = pad(root + entry("Workbook", 2, 0 if small else first, len(book)), 512)
    sectors = [b""] * (total + tables)
    for name, found in places.items():
        for k, place in enumerate(found):
            sectors[place] = chains[name][512 * k : 512 * (k + 1)]
    for k, place in enumerate(table_places):
        sectors[place] = struct.pack("<128I", *table[128 * k : 128 * (k + 1)])
    header = xls.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    header += struct.pack("<IIIIIIIII", 0, tables, places["directory"][0], 0, 4096, places["mini"][0] if mini_table else 0xFFFFFFFE, count["mini"], 0xFFFFFFFE, 0)
    header += struct.pack("<109I", *table_places, *[0xFFFFFFFF] * (109 - tables))
    return header + b"".join(sectors)


def twin(rows, path):
    """The same cells as an .xlsx file."""
    from xml.sax.saxutils import escape

    lines = ""
    for r, row in enumerate(rows):
        cells = ""
        for c, cell in enumerate(row):
            ref = f"{chr(65 + c)}{r + 1}"
            if isinstance(cell, str):
                cells += f'<c r="{ref}" t="inlineStr"><is><t>{escape(cell)}</t></is></c>'
            elif cell is not None:
                cells += f'<c r="{ref}"><v>{cell}</v></c>'
        lines += f'<row r="{r + 1}">{cells}</row>'
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{lines}</sheetData></worksheet>")


def log_rows(n):
    rng = random.Random(2)
    letters = "abc čďěňřž ěščř 日本 xyz"
    rows = [["Hledaný výraz", "Jazyk", "Hledáno", "Nalezeno", "Naposledy hledáno"]]
    for k in range(n):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(3, 60))).strip() or "x"
        rows.append([f"q{k} {text}", rng.choice(["cs", "en", None]), rng.randint(0, 5000), 0.5 if k % 3 else rng.randint(0, 9), f"{1 + k % 28}. {1 + k % 12}. 2024 10:30"])
    return rows


@pytest.mark.parametrize("n,most", [(5, 8224), (300, 8224), (300, 60), (300, 61)])
def test_both_kinds_of_spreadsheet_give_the_same_rows(spark, tmp_path, n, most):
    rows = log_rows(n)
    content = compound(workbook(rows, most))
    assert (len(workbook(rows, most)) < 4096) == (n == 5)
    (tmp_path / "a_search_log.xls").write_bytes(content)
    twin(rows, tmp_path / "b_search_log.xlsx")
    names = {"Hledaný výraz": "query", "Jazyk": "lang", "Hledáno": "clicks", "Nalezeno": "found", "Naposledy hledáno": "last_searched_raw"}
    assert xls.first_sheet(content) == readers.sheet_rows((tmp_path / "b_search_log.xlsx").read_bytes())
    if most == 60:
        return
    got = {}
    for r in readers.read_internal_xls(spark, str(tmp_path), names).collect():
        got.setdefault(r.source_file, []).append((r.query_key, r.query, r.lang, r.clicks, r.found, r.last_searched, r.last_year))
    assert len(got["a_search_log.xls"]) == n and sorted(got["a_search_log.xls"], key=str) == sorted(got["b_search_log.xlsx"], key=str)


def test_kinds_of_cells():
    rows = [["a", None, ("label", "čau"), 7, -3, 2.5], [], [("many", [1, -2, 30]), None, None, ("bool", 1), ("error", 0x2A)], [("formula", "text"), ("formula", 4.0), 1e20]]
    want = [["a", None, "čau", "7", "-3", "2.5"], [], ["1", "-2", "30", "1", "#N/A"], ["text", "4", "1e+20"]]
    assert xls.first_sheet(compound(workbook(rows))) == want
    assert xls.first_sheet(compound(workbook([]))) == []
    locked = record(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12) + record(0x2F, b"\0\0")
    with pytest.raises(ValueError, match="password"):
        xls.first_sheet(compound(locked))


@pytest.fixture
def pages():
    """A server of 1,037 rows, of whose pages some fail at first, some come half and some are refused for a while."""
    rows = [{"id": k, "title": None if k % 10 == 0 else f"t{k}", "tags": [k]} for k in range(1037)]
    asked, lock, grows = Counter(), Lock(), {"by": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            offset, limit = int(q["offset"]), int(q["limit"])
            with lock:
                asked[offset, limit] += 1
                turn = asked[offset, limit]
            data = json.dumps({"items": rows[offset : offset + limit], "total": len(rows) + grows["by"]}).encode()
            code = 503 if offset == 100 and turn < 3 else 429 if offset == 300 and turn == 1 else 200
            code = 401 if self.headers.get("x-token") != "secret" else code
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data[: len(data) // 2] if offset == 500 and turn == 1 else data)
            if offset == 500 and turn == 1:
                self.connection.close()

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rows?kind=all", rows, asked, grows
    server.shutdown()


def options(**more):
    return {"limit": 50, "header": "x-token", "key_variable": "PAGES_KEY", "wait": 0.01, **more}


def test_pages_are_read_in_parts_and_none_is_lost_or_doubled(spark, pages, monkeypatch):
    url, rows, asked, _ = pages
    monkeypatch.setenv("PAGES_KEY", "secret")
    server = http_pages.Server(url, **options())
    reader = http_pages.PagedReader(server, ["id", "title", "tags", "none"], 2)
    parts = reader.partitions()
    assert len(parts) == 11 and (parts[0].start, parts[-1].stop) == (0, 1037)
    found = [row for p in parts for row in reader.read(p)]
    assert found == [(str(r["id"]), r["title"], json.dumps(r["tags"]), None) for r in rows]
    assert asked[100, 50] == 3 and asked[300, 50] == 2 and asked[500, 50] == 2


def test_rows_that_move_meanwhile_fail_the_read(pages, monkeypatch):
    url, _, _, grows = pages
    monkeypatch.setenv("PAGES_KEY", "secret")
    reader = http_pages.PagedReader(http_pages.Server(url, **options()), ["id"], 4)
    parts = reader.partitions()
    grows["by"] = 1
    with pytest.raises(RuntimeError, match="1038 of 1037"):
        list(reader.read(parts[0]))


def test_refusals_are_final(pages, monkeypatch):
    url, _, asked, _ = pages
    monkeypatch.delenv("PAGES_KEY", raising=False)
    with pytest.raises(Exception, match="401"):
        http_pages.Server(url, **options()).page(0, 5)
    assert asked[0, 5] == 1


def test_spark_reads_pages(spark):
    """A server that asks for no key, read by Spark itself."""
    rows = [{"id": k, "note": f"n{k}"} for k in range(230)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            data = json.dumps({"items": rows[q["offset"] : q["offset"] + q["limit"]], "total": len(rows)}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    df = http_pages.read_pages(spark, f"http://127.0.0.1:{server.server_port}/x", ["id", "note"], pages=1, limit=25)
    assert df.rdd.getNumPartitions() == 10
    assert sorted((int(r.id), r.note) for r in df.collect()) == [(r["id"], r["note"]) for r in rows]
    rows.clear()
    assert http_pages.read_pages(spark, f"http://127.0.0.1:{server.server_port}/x", ["id"]).count() == 0
    server.shutdown()
