"""Tables that can be replaced and changed while others read them.

A table is a folder of written parts and of manifests, numbered files that name the parts of one
state.  A change writes new parts first and then the next manifest; who finds its number taken by another
starts anew from that one's state.  So readers see one state or the next, and no change is lost.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_MANIFESTS = "_manifests"
#: Not all file systems create a file only where none is; writers of one driver take turns at it.
_turn = threading.Lock()


class Taken(Exception):
    """Another writer was first."""


class SnapshotTable:
    """The states of the table in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._listed(_MANIFESTS) if n.endswith(".json") and n[:-5].isdigit()]

    def _manifest(self, version: int) -> list[str]:
        stream = self._files.open(self._path(f"{self.path}/{_MANIFESTS}/{version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """A state, the last one unless another is named; None if there is none."""
        known = self.versions()
        if not known:
            return None
        parts = self._manifest(known[-1] if version is None else version)
        return self.spark.read.parquet(*(f"{self.path}/{p}" for p in parts))

    def _written(self, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def _commit(self, version: int, parts: list[str]) -> None:
        """Makes ``parts`` the state of that number; the manifest is whole before it has its name."""
        ready = self._path(f"{self.path}/{_MANIFESTS}/.{uuid.uuid4().hex}")
        named = self._path(f"{self.path}/{_MANIFESTS}/{version:012d}.json")
        out = self._files.create(ready, True)
        out.write(json.dumps(parts).encode())
        out.close()
        with _turn:
            if self._files.exists(named) or not self._files.rename(ready, named):
                self._files.delete(ready, False)
                raise Taken(str(version))

    def _changed(self, change) -> int:
        """Commits the parts that ``change`` makes of the last state's, on whatever state is last in the end."""
        while True:
            last = max(self.versions(), default=0)
            before = self._manifest(last) if last else []
            parts, new = change(last, before)
            try:
                self._commit(last + 1, parts)
                return last + 1
            except Taken:
                for part in new:
                    self._files.delete(self._path(f"{self.path}/{part}"), True)

    def replace(self, df: DataFrame) -> int:
        """The number of the state that is ``df`` alone."""
        part = self._written(df)
        return self._changed(lambda last, before: ([part], []))

    def append(self, df: DataFrame) -> int:
        """The number of the state that has the rows of ``df``, too; they are written once, however many writers there are."""
        part = self._written(df)
        return self._changed(lambda last, before: ([*before, part], []))

    def upsert(self, df: DataFrame, keys: list[str]) -> int:
        """The number of the state in which the rows of ``df`` take the place of those with the same keys, null ones included."""
        new = self._written(df)
        rows = self.spark.read.parquet(f"{self.path}/{new}")

        def change(last: int, before: list[str]) -> tuple[list[str], list[str]]:
            if not before:
                return [new], []
            old, named = self.read(last), rows.select(*keys).distinct().toDF(*(f"_new_{k}" for k in keys))
            same = [old[k].eqNullSafe(named[f"_new_{k}"]) for k in keys]
            kept = self._written(old.join(named, same, "left_anti"))
            return [kept, new], [kept]

        return self._changed(change)

    def clean(self, states: int = 2) -> None:
        """Deletes all but the last ``states`` states, and the parts that only others name; no writer may be under way."""
        known = self.versions()
        kept = known[-states:]
        parts = {p for v in kept for p in self._manifest(v)}
        for v in known[: -len(kept)] if kept else []:
            self._files.delete(self._path(f"{self.path}/{_MANIFESTS}/{v:012d}.json"), False)
        for name in self._listed(""):
            if name.startswith("part-") and name not in parts:
                self._files.delete(self._path(f"{self.path}/{name}"), True)
