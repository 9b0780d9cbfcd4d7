"""Many calls at a time from one task, and a log of their answers that outlives it."""

from __future__ import annotations

import heapq
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: Calls of a task that may hang, for each that may be under way, before no more are made.
HUNG_FACTOR = 2


class TooManyHang(Exception):
    """So many calls hang that no further ones are made."""


def as_completed(
    jobs: Iterator[tuple[Any, Callable[[], Any]]],
    in_flight: int = 8,
    attempts: int = 3,
    seconds: float | None = None,
    wait: float = 0.5,
    most_wait: float = 30.0,
) -> Iterator[tuple[Any, Any, Exception | None]]:
    """key, result and error of each job (key, call), as they end.

    At most ``in_flight`` calls are under way, and jobs are taken as there is room for
    them.  A call that raises is made again, ``attempts`` times in all, after waits that
    double; meanwhile others go on.  One that takes over ``seconds`` counts as failed and
    is left to its thread; while HUNG_FACTOR times ``in_flight`` of these haven't ended, all that is left
    fails at once, so that a server that is gone doesn't fill the worker with threads.
    """
    done: queue.Queue = queue.Queue()
    under_way: dict[int, tuple[Any, Callable, int, float]] = {}
    again: list[tuple[float, int, Any, Callable, int]] = []
    hung: set[int] = set()
    number, more = 0, True

    def run(own: int, call: Callable) -> None:
        try:
            done.put((own, call(), None))
        except Exception as e:
            done.put((own, None, e))

    def ended(key: Any, call: Callable, tries: int, error: Exception) -> Iterator[tuple[Any, Any, Exception]]:
        nonlocal number
        if tries < attempts and not isinstance(error, TooManyHang):
            number += 1
            heapq.heappush(again, (time.monotonic() + min(most_wait, wait * 2 ** (tries - 1)), number, key, call, tries))
        else:
            yield key, None, error

    while True:
        while len(under_way) < in_flight:
            now = time.monotonic()
            if again and again[0][0] <= now:
                _, _, key, call, tries = heapq.heappop(again)
            elif more and (found := next(jobs, None)) is not None:
                (key, call), tries = found, 0
            else:
                more = False
                break
            if len(hung) >= HUNG_FACTOR * in_flight:
                yield key, None, TooManyHang(f"{len(hung)} calls hang")
                continue
            number += 1
            under_way[number] = (key, call, tries + 1, now)
            threading.Thread(target=run, args=(number, call), daemon=True).start()
        if not under_way and not again:
            return
        now = time.monotonic()
        times = [again[0][0]] if again and len(under_way) < in_flight else []
        times += [started + seconds for *_, started in under_way.values()] if seconds is not None else []
        try:
            own, result, error = done.get(timeout=max(0.0, min(times) - now) if times else None)
        except queue.Empty:
            own = None
        if own in under_way:
            key, call, tries, _ = under_way.pop(own)
            if error is None:
                yield key, result, None
            else:
                yield from ended(key, call, tries, error)
        hung.discard(own)
        if seconds is not None:
            now = time.monotonic()
            for own, (key, call, tries, started) in list(under_way.items()):
                if now - started >= seconds:
                    del under_way[own]
                    hung.add(own)
                    yield from ended(key, call, tries, TimeoutError(f"no answer in {seconds} s"))


class Log:
    """Answers of one run in a folder that all executors share, a file for every so many of them.

    Files are written under a name that readers pass over, and renamed once they are whole.  A
    partition's files are in a folder of their own, where a task that takes its place finds them.
    """

    def __init__(self, folder: str, run: str, partition: int, schema: pa.Schema, every: int = 100):
        from pyarrow import fs

        self.schema, self.every, self.rows = schema, every, []
        self.files, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.path = f"{path.rstrip('/')}/run={run}/part={partition}"
        self.files.create_dir(self.path, recursive=True)

    def held(self) -> Iterator[dict]:
        """What an earlier task of the partition has logged."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        for found in self.files.get_file_info(fs.FileSelector(self.path)):
            if found.base_name.endswith(".parquet") and not found.base_name.startswith("_"):
                yield from pq.read_table(found.path, filesystem=self.files, partitioning=None).to_pylist()

    def add(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.every:
            self.write()

    def write(self) -> None:
        import pyarrow.parquet as pq

        if self.rows:
            name = f"{uuid.uuid4().hex}.parquet"
            pq.write_table(pa.Table.from_pylist(self.rows, self.schema), f"{self.path}/_{name}", filesystem=self.files)
            self.files.move(f"{self.path}/_{name}", f"{self.path}/{name}")
            self.rows = []
