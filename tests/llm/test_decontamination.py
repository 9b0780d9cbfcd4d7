"""FM-indexes and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from made_up import words
from sievelight.llm import decontamination as dc
from sievelight.llm import queries, terms

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words_in(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    """(doc_id, n_words, spans' words, items) of each row, by looking at every place."""
    grams = {}
    for item, text in items:
        w = words_in(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words_in(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("kinds,n,texts", [(2, 300, 5), (5, 900, 40), (1, 200, 3), (300, 2000, 10), (3, 1, 1)])
def test_index_finds_every_place(kinds, n, texts):
    rng = np.random.default_rng(kinds)
    symbols = rng.integers(1, kinds + 1, n)
    symbols[rng.choice(n, texts, replace=False)] = 0
    symbols[-1] = 0
    held = dc.Index.build(symbols.astype(np.int64), kinds)
    index = dc.Index(*held.values())
    for size in (1, 2, 5, 10):
        phrases = rng.integers(1, kinds + 1, (50, size))
        low, high = index.ranges(phrases)
        for p, lo, hi in zip(phrases, low, high, strict=True):
            want = [i for i in range(n - size + 1) if (symbols[i : i + size] == p).all()]
            assert sorted(index.places(np.arange(lo, max(lo, hi))).tolist()) == want


def test_suffixes_of_copies_are_in_order():
    rng = np.random.default_rng(5)
    one = rng.integers(5, 9, 70)
    symbols = np.concatenate([np.r_[one, k] for k in range(5)])
    texts = [tuple(symbols[i:]) for i in range(len(symbols))]
    assert dc.suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=texts.__getitem__)


def test_words():
    texts = ["One two-THREE", None, "", " ..", "Äé ÀB\x00c", "a" * 50, "x  y\t"]
    found, starts = terms.words_of(pa.array(texts))
    assert [found[a:b].to_pylist() for a, b in zip(starts, starts[1:])] == [words_in(t) for t in texts]
    part = pa.array(["skip me", *texts]).slice(1)
    assert terms.words_of(part)[0].equals(found)
    assert terms.words_of(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.fixture(scope="module")
def tables(spark, odd_texts):
    rng = random.Random(3)
    passages = [words(100 + k, 30) for k in range(6)]
    items = [
        (1, passages[0]), (2, passages[1].upper()), (2, passages[1]), (3, passages[0] + " " + passages[2]), (4, "short one"),
        (5, None), (6, ""), (7, "..."), (None, passages[3]), (8, words(9, 120)), (9, "same text here today"), (10, passages[0]),
    ]
    docs = list(odd_texts)
    for k in range(60):
        body = words(200 + k, rng.randint(0, 200)).split()
        for p in rng.sample(passages, rng.randint(0, 3)):
            part = p.split()[rng.randint(0, 15) :]
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((1000 + k // 2, rng.choice([" ", "-", ", "]).join(body)))
    docs += [(5000, passages[0])] * 25 + [(6000 + k, "x SHORT, one") for k in range(25)]
    return docs, items


def frame(spark, rows, kind):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], f"{kind}, words string, `group` string").repartition(3)


@pytest.mark.parametrize("shard,block", [(1 << 22, 1 << 17), (700, 40)])
def test_contamination(spark, tables, monkeypatch, shard, block):
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", block)
    docs, items = tables
    index = dc.index_documents
    if shard < 1000:  # texts are cut and shards are many; executors see the size in what they are sent
        monkeypatch.setattr(dc, "SHARD", shard)
        monkeypatch.setattr(dc, "index_documents", lambda d, w, *names: spark.createDataFrame(_indexed(d, w, names), dc._INDEX))
    found = dc.contamination(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).collect()
    monkeypatch.setattr(dc, "index_documents", index)
    assert in_order((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found) == in_order(brute(docs, items))
    for r in found:
        assert r.n_items == len(r.item_ids) and all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))


def _indexed(docs, window, names):
    """The rows of an index, made here."""
    rows = [(k, r[names[0]], r[names[1]] or "") for k, r in enumerate(docs.collect())]
    return [dc._index_row(s).to_pylist()[0] for s in dc._shards(iter(rows), window - 1)]


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(dc, "SHARD", 100)
    text = words(4, 300).replace(" ", " -") + "x" * 1000 + " é " * 30
    pieces = list(dc._long_pieces(text, 9))
    own = [(first, fresh, words_in(piece)) for piece, first, fresh in pieces]
    assert len(own) > 5 and sum(fresh for _, fresh, _ in own) == len(words_in(text))
    for first, fresh, held in own:
        assert held == words_in(text)[first : first + len(held)] and len(held) - fresh == min(9, first + len(held) - fresh)


def test_empty_tables(spark, tables):
    docs, items = (frame(spark, rows, kind) for rows, kind in zip(tables, ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert dc.contamination(docs.limit(0), items).count() == 0
    rows = dc.contamination(docs, items.limit(0)).collect()
    assert len(rows) == docs.count() and not any(r.n_hit or r.n_items or r.spans for r in rows)


def test_passages_are_cut_out(spark):
    assert dc.cut("One, two three. Four", [(1, 3)]) == "One, . Four"
    assert dc.cut("a b c d e", [(0, 1), (2, 4)]) == " b  e"
    passage = words(1, 20)
    docs = frame(spark, [(1, f"Keep this. {passage}! And this."), (None, None), (2, "nothing")], "doc_id long, text string")
    items = frame(spark, [(1, passage)], "item_id long, text string")
    out = dc.decontaminate(docs, items)
    assert out.columns == docs.columns
    assert in_order(r.text for r in out.collect()) == in_order(["Keep this. ! And this.", None, "nothing"])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)]
    found = [tuple(r) for r in queries.op11_decontamination(spark, sf).collect()]
    assert sorted(found) == sorted(want) and any(r[-1] for r in found)
