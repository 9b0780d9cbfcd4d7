"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievelight.plans import (
    cluster_queries,
    golden_queries,
    log_queries,
    metric_queries,
    probe_queries,
    report_queries,
    source_queries,
    task_queries,
)

FLAGSHIP = "probe_eval"
_MODULES = (log_queries, cluster_queries, probe_queries, metric_queries, golden_queries, report_queries, source_queries, task_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
