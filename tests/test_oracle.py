"""Every query runs; those with SQL agree with it on the smallest tables."""

from __future__ import annotations

import math

import pytest

from sievelight import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"mlp_head", "whitened_head", "fuzzy_filter", "head_gaps"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def table(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(norm(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_no_query_keeps_wide_integers(duck):
    for name, sql in registry.oracle_sql().items():
        kinds = {str(d[1]) for d in duck.execute(sql).description}
        assert not {k for k in kinds if "HUGE" in k or "DECIMAL" in k}, name
