"""Queries that must read and return everything do, and agree with their SQL at the scale that the check uses."""

from __future__ import annotations

import pytest

from sievelight import registry
from sievelight.operators import heads
from sievelight.plans import views

from test_oracle import TABLES, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield con


def assert_agrees(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = df.collect()
    assert table(df.columns, got) == table(columns, cursor.fetchall())
    return got


def test_supercluster_flat_holds_every_member(spark, duck):
    rows = assert_agrees(spark, duck, "supercluster_flat")
    assert len(rows) == sum(r.n_queries for r in registry.queries()["supercluster_records"](spark, SF).collect())


def test_multi_key_sort_returns_all_rows_in_order(spark, duck):
    got = [tuple(r) for r in assert_agrees(spark, duck, "multi_key_sort")]
    assert len(got) == views.query_log(spark, SF).count() > 100
    assert got == sorted(got, key=lambda r: (r[0], r[1], -r[2], r[3]))


LOG_QUERIES = sorted(k for k, sql in registry.oracle_sql().items() if "v_query_log" in sql and k != "multi_key_sort")


@pytest.mark.parametrize("name", LOG_QUERIES)
def test_log_queries_agree(spark, duck, name):
    assert_agrees(spark, duck, name)


def test_log_views_hold_sharp_s(spark, duck):
    sql = "SELECT count(*) FILTER (strpos(query, 'ß') > 0), count(*) FROM (" + views.SQL["v_query_log"][0] + ")"
    log = views.query_log(spark, SF)
    n = log.filter("query like '%ß%'").count()
    assert duck.execute(sql).fetchone() == (n, log.count()) and n > 0
    assert log.count() == spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").count()


def test_query_log_keeps_sharp_s(spark, tmp_path):
    texts = [(k, f"Straße Größe {k}", "de", "s", 60) for k in range(1, 7)] + [(7, None, "de", "s", 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.query, r.query_key) for r in views.query_log(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("Straße Größe", "straße große"), 2: ("Straße", "straße"), 3: ("Straße Größe", "straße große"),
        4: ("Straße", "straße"), 5: ("Straße Große", "straße große"), 6: ("Straße", "straße"),
    }


def test_cluster_overview_holds_every_member(spark, duck):
    got = assert_agrees(spark, duck, "cluster_overview")
    want = duck.execute("SELECT CAST(cluster_id AS VARCHAR), query_key FROM (" + views.SQL["v_clusters"][0] + ") WHERE cluster_id <> -1").fetchall()
    assert sorted((str(r.cluster_id), r.query_key) for r in got) == sorted(want)


def test_heads_have_their_full_size(spark, monkeypatch):
    class Made(Exception):
        pass

    def fitted(train, hidden, passes, seed):
        raise Made(hidden, passes)

    def parts(**params):
        raise Made(params["k"])

    monkeypatch.setattr(heads.perceptron, "fit", fitted)
    monkeypatch.setattr(heads, "PCA", parts)
    for name, sizes in (("mlp_head", (256, 400)), ("whitened_head", (64,))):
        with pytest.raises(Made) as found:
            registry.queries()[name](spark, SF)
        assert found.value.args == sizes
