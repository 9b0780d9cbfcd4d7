"""Writers; Spark's commit protocol makes each all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, partitions: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Adds files to a table; what is there is not read."""
    df.write.mode("append").parquet(path)


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def flat_super_clusters(records: DataFrame, path: str) -> None:
    from sievelight.operators.clusters import exploded_super_clusters

    write_csv(exploded_super_clusters(records), path)


def annotation_sheet(items: DataFrame, keep: list[str], raters: list[str], axes=("MU", "PU", "ET")) -> DataFrame:
    """Items with a blank column for each rater and axis."""
    return items.select(*keep, *(F.lit("").alias(f"{r}_{a}") for r in raters for a in axes))
