"""Where intermediate results go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder, others the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        local = spark.sparkContext.master.startswith("local")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievelight-") if local else f"{warehouse}/_work")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The frame as a written table: computed once, however many plans use it, and there if executors are lost.

    Plans on it read the columns and rows that they need, and know its size.
    """
    path = f"{work_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """The written tables of one run, in a folder of its own, of which those that no result reads can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`settled`."""
        self.tables += 1
        path = f"{self.path}/{name}.{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, *names: str) -> None:
        """Deletes the tables of all other names."""
        self._drop(lambda name: name not in names)

    def drop(self, *names: str) -> None:
        self._drop(lambda name: name in names)

    def _drop(self, goes) -> None:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.listStatus(root) if files.exists(root) else []:
            if goes(found.getPath().getName().rpartition(".")[0]):
                files.delete(found.getPath(), True)
