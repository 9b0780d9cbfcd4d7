"""WARC archives and a globally ordered index of their captures.

Every record is a gzip member of its own, so that an index entry's offset and length are
all that is needed to read it.  Archives are written through Spark's own writer, so they go
wherever the session's file systems reach, and end by bytes, not by records.  Reading an
archive, a record at a time, gives a run of index entries, sorted by URL key and timestamp.
The runs are dealt out by key ranges of bounded size, and each range merges its part of
all runs with a loser tree, block by block, into the ordered history of captures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import Scratch, materialise, new_path, small_batches, trimmed, whole_text

#: Payloads of fewer bytes are always kept as responses.
LEAST_REVISIT = 100
#: An archive ends after the record with which it reaches this many bytes.
ARCHIVE_BYTES = 16 << 20
#: Entries of a key range, about, and the rows of a run that the tree holds at a time.
ENTRIES_A_RANGE = 1 << 17
RUN_BLOCK = 1024
#: Entries that are worth a task of their own as long as there are cores without any.
LEAST_RANGE = 4096
_READ_BYTES = 1 << 14
_END = "\r\n"


class LoserTree:
    """Merges sorted iterators; each step replays one path of a tournament's losers."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.n = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.n
        for k in range(self.n):
            self._replay(k)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _replay(self, winner: int) -> None:
        node = (winner + self.n) // 2
        while node > 0:
            if self.losers[node] == -1:
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def url_key(url: str) -> str:
    """Host labels from the top level down, then port, path and query; scheme and fragment play no part."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def with_revisits(
    pages: DataFrame, scratch: Scratch, id_column: str = "page_id", html_column: str = "html"
) -> DataFrame:
    """``pages`` as page_id, url, html, digest, bytes and refers_to.

    refers_to is the smallest id among the records of an equal payload of at least
    ``LEAST_REVISIT`` bytes, and null on that record itself and on shorter ones.
    """
    page = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        whole_text(html_column).alias("html"),
    )
    page = page.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long")})
    same = page.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    same = scratch.keep(same.select("digest", "first_id"), "same")
    joined = page.join(same, "digest", "left")
    return joined.withColumn(
        "refers_to",
        F.when(F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull()), F.col("first_id")),
    ).drop("first_id")


def record(page: DataFrame) -> Column:
    """The whole record of each row of :func:`with_revisits`."""
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")
    date = F.date_format(
        F.to_utc_timestamp(
            F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)) + 1704067200),
            F.current_timezone(),
        ),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(_END + _END),
    )
    block = F.when(revisit, head).otherwise(F.concat(head, "html"))
    lines = F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{_END}WARC-Record-ID: "), uri(F.col("page_id")),
        F.lit(f"{_END}WARC-Date: "), date,
        F.lit(f"{_END}WARC-Target-URI: "), url,
        F.lit(f"{_END}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(
                    f"{_END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}WARC-Refers-To: "
                ),
                uri(F.col("refers_to")),
            ),
        ).otherwise(""),
        F.lit(
            f"{_END}Content-Type: application/http; msgtype=response{_END}Content-Length: "
        ), F.octet_length(block).cast("string"),
        F.lit(_END + _END),
    )
    return F.concat(lines, block, F.lit(_END + _END))


def member(data: bytes) -> bytes:
    """A gzip member of ``data``, the same for the same bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: A member of nothing; like every member of less than 16 MB it ends in a zero byte, the last of its size.
NOTHING = member(b"")


def _pack(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members without their last byte, which is zero, and the archive of this task that each goes to."""
        written = 0
        for batch in batches:
            values, archives = [], []
            for data in batch.column(0):
                packed = member(data.as_buffer())
                values.append(packed[:-1] if packed[-1] == 0 else packed + NOTHING[:-1])
                archives.append(written // archive_bytes)
                written += len(values[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.binary()), pa.array(archives, pa.int32())], names=["value", "archive"]
            )

    return run


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for every row to archives below ``path``, each a file of concatenated gzip members.

    The text writer puts out the bytes of a string as they are, and its separator is the
    zero byte that every member here ends with.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    page = with_revisits(small_batches(pages), scratch)
    packed = page.select(record(page).cast("binary").alias("value")).mapInArrow(
        trimmed(_pack(archive_bytes)), "value binary, archive int"
    )
    packed.select(F.col("value").cast("string"), "archive").write.partitionBy("archive").option("lineSep", "\x00").text(path)
    scratch.drop_all_but()


def members(data) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and inflated bytes of each member of an archive, one at a time; members of nothing are passed over."""
    data, at = memoryview(data), 0
    while at < len(data):
        start, parts, unpacker = at, [], zlib.decompressobj(31)
        while not unpacker.eof:
            some = data[at : at + _READ_BYTES]
            if not len(some):
                raise ValueError(f"the member at byte {start} has no end")
            parts.append(unpacker.decompress(some))
            at += len(some)
        at -= len(unpacker.unused_data)
        whole = b"".join(parts)
        if whole:
            yield start, at - start, whole


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split(_END)
    if not blank or not lines[0].startswith("WARC/"):
        raise ValueError("no record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record is not as long as it says")
    return headers, rest[:size]


def records(data) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive."""
    for at, length, whole in members(data):
        try:
            yield at, length, *parsed(whole)
        except ValueError as wrong:
            raise ValueError(f"{wrong} at byte {at}") from wrong


_FIELDS = [
    ("url_key", pa.string(), "string"), (
        "timestamp", pa.string(), "string"
    ), (
        "page_id", pa.int64(), "long"
    ), ("file", pa.string(), "string"), ("offset", pa.int64(), "long"), ("length", pa.int64(), "long"),
    ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), (
        "payload_digest", pa.string(), "string"
    ), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long"),
]
INDEX = ", ".join(f"{name} {kind}" for name, _, kind in _FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, (_, t, _) in zip(zip(*rows, strict=True), _FIELDS, strict=True)],
        names=[n for n, _, _ in _FIELDS],
    )


def _number(uri: str | None) -> int | None:
    value = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def entry(file: str, at: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record; a response's payload is hashed anew and must have its digest.

    Offset and length are those of the record's gzip member in its archive.
    """
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    kind = headers["warc-type"]
    if kind == "response":
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{file}: the payload at byte {at} does not have its digest")
    else:
        size = int(
            next(line.split(b":")[1] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        )
    url = headers["warc-target-uri"]
    return url_key(url), headers["warc-date"], _number(
        headers["warc-record-id"]
    ), file, at, length, url, size, digest, kind, _number(
        headers.get("warc-refers-to")
    )


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[3], row[4]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = sorted((entry(file, *r) for r in records(content.as_buffer())), key=_order)
            for lo in range(0, len(rows), RUN_BLOCK):
                part = _batch(rows[lo : lo + RUN_BLOCK])
                place = pa.array(range(lo, lo + part.num_rows), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, place], names=[*part.schema.names, "place"])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index of each archive below ``path`` and each entry's place in its run; the entries of an archive are a sorted run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "part-*"
    ).load(path)
    return files.select(F.substring_index("path", "/", -2).alias("file"), "content").mapInArrow(
        trimmed(_read), f"{INDEX}, place int"
    )


_KEY = ("url_key", "timestamp", "page_id", "file", "offset")


def _run(table: pa.Table, start: int, end: int) -> Iterator[tuple[tuple, int]]:
    """Order and row of each entry of a run, of which only a block is held as Python values."""
    for lo in range(start, end, RUN_BLOCK):
        block = table.slice(lo, min(RUN_BLOCK, end - lo))
        keys = zip(*(block.column(c).to_pylist() for c in _KEY), strict=True)
        for row, (url, time, page, file, at) in enumerate(keys, lo):
            yield (url, time, page is None, page or 0, file, at), row


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its runs, one after another and each in its order, merged by a loser tree."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    files = table.column("file").combine_chunks().dictionary_encode()
    files = (files.chunk(0) if isinstance(files, pa.ChunkedArray) else files).indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, files[1:] != files[:-1]]).tolist()
    runs = [_run(table, lo, hi) for lo, hi in zip(starts, [*starts[1:], len(files)], strict=True)]
    table = table.drop_columns(["place"])
    order: list[int] = []
    for _, row in LoserTree(runs):
        order.append(row)
        if len(order) == 4096:
            yield from table.take(pa.array(order)).combine_chunks().to_batches()
            order = []
    if order:
        yield from table.take(pa.array(order)).combine_chunks().to_batches()


def merge_runs(runs: DataFrame) -> DataFrame:
    """All entries in the order of URL key, timestamp and page, by k-way merges of key ranges.

    ``runs`` is written, as :func:`read_runs` has it.  There are as many ranges as keep each
    at about ``ENTRIES_A_RANGE`` entries, however many there are; a key with very many
    captures is spread over several, and so are captures that differ only in their place.
    Within a range Spark's external sort puts the blocks of each run one after another
    again; partitions follow one another.
    """
    n, cores = runs.count(), runs.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-n // ENTRIES_A_RANGE), min(cores, -(-n // LEAST_RANGE)))
    dealt = runs.repartitionByRange(
        ranges, "url_key", "timestamp", F.col("page_id").asc_nulls_last(), "file", "offset"
    )
    return dealt.sortWithinPartitions("file", "place").mapInArrow(trimmed(_merge), INDEX)


def archive_and_index(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of ``pages``, reads them back and returns their merged index.

    Null html counts as empty and a null url as the empty one.  Rows that repeat an id
    get a record each; of equal payloads all rows with the smallest id are responses.  A
    null id stays null.  An empty table gives no entries.
    """
    spark = pages.sparkSession
    where = path or new_path(spark, "warc")
    write_archives(pages, where, archive_bytes)
    return merge_runs(materialise(read_runs(spark, where), "warc-runs"))
