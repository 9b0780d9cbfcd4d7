from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np

from sievelight.llm import exact_dedup as ed
from sievelight.llm import queries


def truth(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        text = text or ""
        norm = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        groups[hashlib.sha256(norm.encode()).hexdigest()].append((-len(text), doc is None, doc or 0, doc))
    return {sha: (min(g)[3], len(g)) for sha, g in groups.items()}


def test_matches_brute_force(odd, odd_texts):
    got = ed.exact_duplicates(odd).collect()
    want = truth(odd_texts)
    assert len(got) == len(odd_texts)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    for sha in want:
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_saturated_filter_is_exact(odd, odd_texts, monkeypatch):
    monkeypatch.setattr(ed, "probes", lambda hashes, bits, n: np.zeros((n, len(hashes)), np.int64))
    want = truth(odd_texts)
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in ed.exact_duplicates(odd).collect())


def test_filter_with_few_bits_a_row_still_passes_rows_by(spark):
    """At every size all repeated hashes are found; with one bit a row and more, many others pass straight through."""
    n = 60_000
    hashes = spark.range(n).selectExpr("xxhash64(id) AS hash").union(spark.range(500).selectExpr("xxhash64(id) AS hash"))
    told = {}
    for bits in (1 << 16, 1 << 18, 1 << 20):
        level = ed.repeated_filter(hashes, n, bits)
        assert len(level) * 8 == bits
        seen = hashes.withColumn("maybe", ed.maybe_repeated(hashes, level, n, "hash"))
        told[bits] = seen.filter("maybe").count()
        assert seen.filter("maybe").join(spark.range(500).selectExpr("xxhash64(id) AS hash"), "hash").count() == 1000
    assert 1000 <= told[1 << 20] < told[1 << 18] < told[1 << 16]
    # With one probe a row passes by if no other hash set its bit.
    assert told[1 << 16] < 1.05 * (n + 500) * (1 - math.exp(-(n + 500) / (1 << 16)))
    assert ed.most_bits(spark) >= 1 << 27


def test_drop_keeps_columns_and_one_row_a_group(odd, odd_texts):
    kept = ed.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in truth(odd_texts).values())


def test_empty(none):
    assert ed.exact_duplicates(none).count() == 0
    assert ed.drop_exact_duplicates(none).count() == 0


def test_query_agrees_with_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = sorted(
            con.execute(
                f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.ORACLE_SQL['op9_exact_dedup']})"
            ).fetchall()
        )
    assert sorted(tuple(r) for r in queries.op9_exact_dedup(spark, sf).collect()) == want


def test_ids_at_both_ends(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "a b"), (high, "a b"), (0, "ab "), (low, "one"), (high, "two"), (None, "a\tb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text_sha256): r for r in ed.exact_duplicates(docs).collect()}
    want = truth(rows)
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size, r.kept) == (*want[sha], doc == want[sha][0]) for (doc, sha), r in got.items())
    assert sorted(ed.drop_exact_duplicates(docs).select("doc_id").toPandas().doc_id.tolist()) == [low, low, high]
