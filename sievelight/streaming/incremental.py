"""Incremental embedding of new keys by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sievelight.sources.providers import Embedder, embed_missing


def embed_stream(
    texts: DataFrame, embedder: Embedder, table: str, checkpoint: str, key: str = "text_id", available_now: bool = True
) -> StreamingQuery:
    """Appends the embedding of each key that ``table`` lacks; a batch that is run again adds nothing twice."""
    spark = texts.sparkSession
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, embedding array<double>, error string"

    def batch(rows: DataFrame, _: int) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        done = rows.sparkSession.read.schema(schema).parquet(table).filter("error is null") if there else None
        embed_missing(rows, done, embedder, key).write.mode("append").parquet(table)

    writer = texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
