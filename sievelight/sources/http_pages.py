"""Rows of a server that hands them out in pages, as a data source."""

from __future__ import annotations

import http.client
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "http_pages"
#: Answers after which a request is made again; others of 400 and above are final.
_AGAIN = {408, 425, 429, 500, 502, 503, 504}


@dataclass(frozen=True)
class Server:
    """How pages are asked for: offset and limit in the query, and a header with a key that is read where the request is made."""

    url: str
    limit: int = 500
    offset_name: str = "offset"
    limit_name: str = "limit"
    rows_name: str = "items"
    total_name: str = "total"
    header: str = "Authorization"
    key_variable: str = ""
    attempts: int = 5
    wait: float = 0.5
    seconds: float = 60.0

    def page(self, offset: int, limit: int) -> tuple[list[dict], int]:
        """Rows and their number in all; a request that fails is made again after waits that double or that the server names."""
        asked = urllib.parse.urlencode({self.offset_name: offset, self.limit_name: limit})
        request = urllib.request.Request(f"{self.url}{'&' if '?' in self.url else '?'}{asked}")
        if self.key_variable and os.environ.get(self.key_variable):
            request.add_header(self.header, os.environ[self.key_variable])
        for k in range(self.attempts):
            wait = self.wait * 2**k
            try:
                with urllib.request.urlopen(request, timeout=self.seconds) as answer:
                    found = json.load(answer)
                return found[self.rows_name], int(found[self.total_name])
            except urllib.error.HTTPError as e:
                if e.code not in _AGAIN or k == self.attempts - 1:
                    raise
                named = e.headers.get("Retry-After", "")
                wait = float(named) if named.isdigit() else wait
            except (OSError, ValueError, KeyError, http.client.HTTPException):  # no connection, half an answer
                if k == self.attempts - 1:
                    raise
            time.sleep(wait)
        raise AssertionError


@dataclass
class Pages(InputPartition):
    start: int
    stop: int
    total: int


class PagedReader(DataSourceReader):
    """Partitions of a few pages each, dealt by the total that the server states first.

    A page is to have just the rows that its place gives it, and the total to stay as it is; otherwise rows moved
    meanwhile, and the read fails, as some might be lost or come twice.
    """

    def __init__(self, server: Server, fields: list[str], pages: int):
        self.server, self.fields, self.pages = server, fields, pages

    def partitions(self) -> list[Pages]:
        _, total = self.server.page(0, 1)
        step = self.pages * self.server.limit
        return [Pages(k, min(k + step, total), total) for k in range(0, total, step)] or [Pages(0, 0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for offset in range(partition.start, partition.stop, self.server.limit):
            want = min(self.server.limit, partition.stop - offset)
            rows, total = self.server.page(offset, want)
            if total != partition.total or len(rows) != want:
                raise RuntimeError(f"{len(rows)} rows of {want} at {offset}, {total} of {partition.total} in all")
            for row in rows:
                yield tuple(None if row.get(f) is None else str(row[f]) if not isinstance(row[f], (dict, list)) else json.dumps(row[f]) for f in self.fields)


class HttpPages(DataSource):
    """All fields come as text (nested ones as JSON), by the names in the schema that is given."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("a schema has to be given")

    def reader(self, schema: StructType) -> PagedReader:
        given = {k.lower(): v for k, v in self.options.items()}
        kinds = {f: type(getattr(Server, f, "")) for f in Server.__dataclass_fields__}
        server = Server(**{f: kinds[f](given[f.lower()]) for f in kinds if f.lower() in given})
        return PagedReader(server, schema.names, int(given.get("pages", 4)))


def read_pages(spark: SparkSession, url: str, fields: list[str], pages: int = 4, **options) -> DataFrame:
    """``fields``, as text, of all rows at ``url``; ``pages`` are read one after another by a task, ``options`` are those of Server."""
    spark.dataSource.register(HttpPages)
    schema = ", ".join(f"`{f}` string" for f in fields)
    return spark.read.format(NAME).schema(schema).options(url=url, pages=pages, **options).load()
