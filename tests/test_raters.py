"""Detection of raters on sheets of any size."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from sievelight import registry
from sievelight.operators import golden


def test_rater_of_few_rows_is_none_on_a_large_sheet(spark, tmp_path):
    """Of 10,000 items every 50th has a second rating: 200 values, but of 2 % of the rows."""
    i = F.col("id")
    rows = spark.range(10000).select(
        i.alias("doc_id"), (i % 2).cast("int").alias("quality"), (i % 5 == 0).cast("int").alias("toxic")
    )
    rows.write.parquet(f"{tmp_path}/labels.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/labels.parquet/*.parquet'")
        want = Counter(con.execute(registry.oracle_sql()["rater_detection"]).fetchall())
    got = registry.queries()["rater_detection"](spark, str(tmp_path)).select("doc_id", "rater", "axis", "grade")
    assert Counter(map(tuple, got.collect())) == want and len(want) == 30000


def test_share_of_rows(spark):
    wide = spark.range(20).select(
        *(F.col("id").alias(f"ann_{a}") for a in ("MU", "PU", "ET")),
        *(F.when(F.col("id") < 15, F.col("id")).alias(f"bob_{a}") for a in ("MU", "PU", "ET")),
        *(F.when(F.col("id") < 14, F.col("id")).alias(f"cy_{a}") for a in ("MU", "PU", "ET")),
    )
    assert golden.raters_of(wide, least=5) == ["ann", "bob", "cy"]
    assert golden.raters_of(wide, least=5, share=0.75) == ["ann", "bob"]
    assert golden.raters_of(wide, least=16, share=0.75) == ["ann"]
    assert golden.raters_of(wide.limit(0), least=5, share=0.75) == []
