"""Unifying query logs: weighted deduplication, canonical files, pivots by source."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(x: str, weight: str) -> Column:
    """Mean of ``x`` by ``weight``: nulls of x add nothing and dilute; with no weight at all the plain mean."""
    total = F.sum(weight)
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.avg(x)).otherwise(
        F.coalesce(F.sum(F.col(x) * F.col(weight)), F.lit(0.0)) / total
    )


def representative(value: str, clicks: str, *ties: str) -> Column:
    """``value`` of the row with most clicks; ties go to the smaller value, then to the other columns."""
    order = F.struct(
        (-F.coalesce(F.col(clicks), F.lit(0))).alias("by_clicks"),
        F.col(value).alias("by_value"),
        *(F.col(t).alias(f"by_{t}") for t in ties),
    )
    return F.min_by(value, order)


def dedup(
    log: DataFrame,
    keys: list[str],
    text: str = "query",
    clicks: str = "clicks",
    sums: Iterable[str] = ("clicks", "impressions"),
    rates: Iterable[str] = ("ctr",),
) -> DataFrame:
    """One row for each key: sums (null counts as 0), click-weighted rates and the most clicked text.  One shuffle."""
    return log.groupBy(*keys).agg(
        representative(text, clicks).alias(text),
        *(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums),
        *(weighted_mean(r, clicks).alias(r) for r in rates),
        F.count(F.lit(1)).alias("n_rows"),
    )


def canonical_files(log: DataFrame, by: list[str], file: str, start: str, end: str, clicks: str) -> DataFrame:
    """For each group the file of the longest span, then of most clicks, then of the smallest name."""
    files = log.groupBy(*by, file).agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.sum(clicks).alias("clicks")
    )
    span = F.datediff("end", "start")
    order = F.struct(
        (-F.coalesce(span, F.lit(-1))).alias("a"), (-F.coalesce("clicks", F.lit(0))).alias("b"), F.col(file).alias("c")
    )
    return files.groupBy(*by).agg(
        F.min_by(F.struct(file, "start", "end", "clicks"), order).alias("best")
    ).select(*by, "best.*")


def pivot_sums(log: DataFrame, keys: list[str], source: str, sources: list[str], value: str, prefix: str) -> DataFrame:
    """A column for each source with the sum of ``value``, 0 where there is none."""
    return log.groupBy(*keys).agg(
        *(F.coalesce(F.sum(F.when(F.col(source) == s, F.col(value))), F.lit(0)).alias(f"{prefix}_{s}") for s in sources)
    )


def cross_source(log: DataFrame, sources: list[str], key: str = "query_key") -> DataFrame:
    """One row a key over all sources: null-preserving sums, diluted rates, the sources' names and clicks of each."""
    return log.groupBy(key).agg(
        representative("query", "clicks", "source").alias("query"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        weighted_mean("ctr", "clicks").alias("ctr"),
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
        F.count_distinct("source").alias("n_sources"),
        F.max("last_searched").alias("last_searched"),
        *(
            F.coalesce(F.sum(F.when(F.col("source") == s, F.col("clicks"))), F.lit(0)).alias(f"clicks_{s}")
            for s in sources
        ),
    )
