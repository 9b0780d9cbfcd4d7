"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the word and text contracts name: space and \x09 to \x0d.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that was just read, over all cores if it has fewer partitions than there are; larger ones as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names.  Where that is unset, a local
    session gets a temporary folder and any other the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="sievelight-")
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again.

    This cuts the lineage: what was written survives the loss of executors, and
    generated ids stay as they are.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one run, in a folder of its own.

    A table that the result doesn't read any more can be dropped before the result is
    asked for, so that a run leaves no more than it needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, new_path(spark, name), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`materialise`."""
        self.tables += 1
        path = f"{self.path}/{name}.{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, *names: str) -> None:
        """Deletes the tables of all other names."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.listStatus(root):
            if found.getPath().getName().rpartition(".")[0] not in names:
                files.delete(found.getPath(), True)


#: Rows at most that go to Python together, where they hold whole texts.
ARROW_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session texts go to Python in batches of at most ``ARROW_ROWS`` rows from now on.

    Batches of both sides are held in memory outside the heap; smaller settings are kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= ARROW_ROWS:
        conf.set(key, ARROW_ROWS)
    return df


def trimmed(run):
    """The batch function, after which its worker gives free memory back: idle workers stay alive for a while."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps what it keeps


def whole_text(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """True for the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def hash_bound(share: float) -> int:
    """The value up to which xxhash64 lies for about this share of all inputs."""
    return min(2**63 - 1, int(-(2**63) + min(1.0, share) * 2**64))


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it clear of the columns of ``df``."""
    return clear_names(df.columns, *names)


def clear_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it clear of ``columns`` and of one another."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
