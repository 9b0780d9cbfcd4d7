"""Ranked lexical search against scoring every document."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from made_up import words
from sievelight.llm import lexical_search as ls
from sievelight.llm import queries
from test_decontamination import words_in


def brute(docs, items, k=50):
    """item, rank, document and score of every item's highest documents."""
    held = [(d, Counter(words_in(t))) for d, t in docs]
    n_documents, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    holding = Counter(t for _, c in held for t in c)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(words_in(text))
    out = []
    for item, own in terms.items():
        scores = []
        for doc, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_documents // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in own & c.keys()
            )
            scores += [(-score, doc is None, doc or 0, doc)] if score else []
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_bitmaps_add_up(seed):
    rng = np.random.default_rng(seed)
    n, total, want = 200, [], np.zeros(256, np.int64)
    for _ in range(7):
        places = np.sort(rng.choice(n, rng.integers(0, n), replace=False))
        values = rng.integers(0, 1 << rng.integers(1, 40), len(places))
        want[places] += values
        ls.add(total, ls.bitmaps(places, values, 4))
    assert ls.values_at(total, np.arange(256)).tolist() == want.tolist()
    for k in (1, 3, 50, 300):
        best = sorted(np.flatnonzero(want), key=lambda i: (-want[i], i))[:k]
        assert ls.highest(total, k).tolist() == sorted(best)


def test_equal_numbers_go_by_place():
    total = []
    ls.add(total, ls.bitmaps(np.arange(100), np.r_[np.full(50, 4), np.full(50, 6)], 2))
    assert ls.highest(total, 60).tolist() == [*range(10), *range(50, 100)]
    assert ls.highest([], 5).tolist() == []
    assert ls.highest([np.zeros(2, np.uint64)], 5).tolist() == []


@pytest.fixture(scope="module")
def tables(odd_texts):
    rng = random.Random(4)
    docs = list(odd_texts) + [(100 + k // 2, words(rng.randint(0, 60), rng.randint(0, 90))) for k in range(300)]
    docs += [(1000 + k, "one hot text") for k in range(120)] + [(None, "one hot text"), (None, "one hot")]
    items = [(k, words(k, 20)) for k in range(30)] + [
        (1, words(40, 5)), (50, None), (51, ""), (52, "HOT hot one"), (53, "naïve 東京"), (None, "one text"), (None, "here"), (54, "nowhere to be found zzzz"), (55, "...")
    ]
    return docs, items


def frame(spark, rows, kind):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], f"{kind}, score string, term string").repartition(3)


@pytest.mark.parametrize("terms,k", [(1 << 18, 50), (100, 7)])
def test_search(spark, tables, monkeypatch, terms, k):
    monkeypatch.setattr(ls, "BLOCK_TERMS", terms)
    docs, items = tables
    found = ls.search(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), k)
    assert in_order(found.collect()) == in_order(brute(docs, items, k))


def test_items_with_names(spark):
    found = ls.search(frame(spark, [(1, "a b"), (2, "b")], "doc_id long, text string"), frame(spark, [("x", "a"), (None, "b c")], "item_id string, text string"))
    assert [(r.item_id, r.doc_id) for r in found.orderBy("item_id", "rank").collect()] == [(None, 2), (None, 1), ("x", 1)]


def test_blocks_and_long_texts(tables):
    import pyarrow as pa

    docs, _ = tables
    rows = pa.record_batch({"doc_id": [3, None, 1], "n_terms": [5, 2, 9], "terms": pa.array([[0, 1], [1], [0]], pa.list_(pa.int32())), "counts": [[2, 1], [2], [4]]})
    block = ls.Block([rows], np.array([7, 9]), 3, 16)
    assert block.ids.to_pylist() == [1, 3, None]
    places, scores = block.search(np.array([0, 1]), np.array([True, False]), 5)
    want = [ls.impacts(np.array([w]), np.array([c]), np.array([n]), 3, 16)[0] for w, c, n in ((7, 4, 9), (7, 2, 5), (9, 1, 5), (9, 2, 2))]
    assert places.tolist() == [0, 1, 2] and scores.tolist() == [want[0], want[1] + want[2], want[3]]


def test_texts_in_parts(monkeypatch):
    import pyarrow as pa

    from sievelight.llm import terms

    texts = ["ab cd-ef", None, "x" * 50 + " y " * 30, "", "é" * 20 + " z"]
    words_by_row = {}
    for rows, part in terms.parts(pa.array(texts), 10):
        found, starts = terms.words_of(part)
        for row, a, b in zip(rows, starts, starts[1:]):
            words_by_row.setdefault(int(row), []).extend(found[a:b].to_pylist())
    assert [words_by_row.get(k, []) for k in range(len(texts))] == [words_in(t) for t in texts]


def test_empty_tables(spark, tables):
    docs, items = (frame(spark, rows, kind) for rows, kind in zip(tables, ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert ls.search(docs.limit(0), items).count() == 0
    assert ls.search(docs, items.limit(0)).count() == 0
    assert ls.search(docs.selectExpr("doc_id", "cast(null as string) as text"), items).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert in_order(queries.op13_lexical_search(spark, sf).collect()) == in_order(brute(docs, items))
