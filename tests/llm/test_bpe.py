from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievelight.llm import bpe

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def ids_of(reference, text):
    return reference.encode(text, add_special_tokens=False).ids


def test_round_trip_of_odd_texts(odd, odd_texts, reference):
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.round_trip(odd, NAME).collect()}
    for doc, text in odd_texts:
        ids = ids_of(reference, text or "")
        r = got[doc, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_texts_go_through_pieces(odd, odd_texts, reference):
    rows = bpe.encode(odd, NAME, ["doc_id"], long_text=64, part=16).collect()
    assert len(rows) == len(odd_texts)
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == sorted(
        (str(d), ids_of(reference, t or "")) for d, t in odd_texts
    )


def test_kept_columns_of_any_name(odd, odd_texts, reference):
    docs = odd.withColumns({"piece": odd.doc_id, "kept": odd.text})
    got = bpe.encode(docs, NAME, ["sha", "ids", "text", "piece"], long_text=64)
    assert got.columns == ["sha", "ids", "text", "piece", "_ids"]
    rows = got.collect()
    assert len(rows) == len(odd_texts)
    assert all(r["_ids"] == ids_of(reference, r.text or "") and r.ids == r.sha == "clash" for r in rows)
    back = bpe.decode(got, NAME, ["ids", "text"], ids_column="_ids")
    assert back.columns == ["ids", "text", "_text"]
    assert all(r["_text"] == (r.text or "") for r in back.collect())


SF = "/root/testdata/sf0.01"


def test_query_against_the_library(spark, reference):
    """Every document of the query, whose own rows go through joins of both kinds."""
    from sievelight.llm import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sum(len(t) > bpe.PART for t in texts.values()) > len(texts) / 2
    assert any(len(t) > bpe.LONG_TEXT for t in texts.values())
    rows = queries.op3_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = ids_of(reference, texts[r.doc_id])
        back = reference.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_joins_do_the_work_of_the_query(monkeypatch):
    """Of a text of ordinary length every part is encoded by itself and every neighbour joined."""
    calls = []
    joined = bpe.join
    monkeypatch.setattr(bpe, "join", lambda *a: calls.append(1) or joined(*a))
    text = "one two three " * 700
    assert bpe.encode_text(text, NAME) == bpe.codec(NAME).encode(text)
    assert len(calls) == len(bpe.halves(text, bpe.PART)) - 1 > 10


@pytest.mark.parametrize(
    "text",
    [
        "a" * 3000,
        "ab" * 1501 + "c",
        " " * 999,
        "\n" * 700 + "x",
        "1234567890" * 200,
        "é" * 901,
        "don't'll've're" * 90,
        "東京" * 400,
        "<|endoftext|>" * 90,
        "!?" * 300 + "it's" * 77,
        "\U0001f600\U0001f3fd" * 150,
    ],
)
@pytest.mark.parametrize("limit", [17, 64, 250])
def test_unsplit_runs(text, limit, reference):
    assert bpe.encode_text(text, NAME, limit) == ids_of(reference, text)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.sampled_from([*"abetionTHE  \n\t'sdlr.,!0129é—東́<|>", "<|endoftext|>", "'ll", "   ", "\U0001f600"]), max_size=400
    ).map("".join),
    st.integers(4, 60),
)
def test_any_text(text, limit):
    own = bpe.codec(NAME)
    assert bpe.encode_text(text, NAME, limit) == own.slow.encode(text, add_special_tokens=False).ids


def test_fast_and_slow_agree_on_all_usual_characters():
    own = bpe.codec(NAME)
    usual = [chr(k) for k in range(0x3000) if not bpe._UNUSUAL.search(chr(k))]
    for c in usual:
        text = f"a{c}b1{c}2 {c} .{c}, {c}{c} x"
        assert own.fast.encode_ordinary(text) == own.slow.encode(text, add_special_tokens=False).ids


def test_decoding_of_any_ids(reference):
    import random

    import pyarrow as pa

    own, rng = bpe.codec(NAME), random.Random(1)
    lists = [[rng.choice([rng.randrange(50257), rng.randrange(256), 50256]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    column = pa.array(lists, pa.list_(pa.int32()))
    for part in (column, column.slice(7, 100)):
        want = part.to_pylist()
        assert list(bpe.id_lists(part)) == want
        assert bpe.digests(part) == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in want]
    assert [own.decode(x) for x in lists] == [reference.decode(x, skip_special_tokens=False) for x in lists]
    assert own.decode([15496, 60000]) == reference.decode([15496, 60000], skip_special_tokens=False)


def test_slices():
    import pyarrow as pa

    assert list(bpe.slices(pa.array([], pa.int32()))) == []
    assert list(bpe.slices(pa.array([5, 5, 5, 100, 1, 1], pa.int32()), 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    texts = pa.array(["one two", "", "é" * 3000, "x"]).slice(1)
    assert encoded_lists(texts) == [bpe.codec(NAME).encode(t) for t in texts.to_pylist()]


def encoded_lists(texts):
    return list(bpe.id_lists(bpe.encoded(texts, NAME, 100)))


def test_decode(odd, odd_texts):
    rows = bpe.decode(bpe.encode(odd, NAME, ["doc_id"]), NAME, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted((str(d), t or "") for d, t in odd_texts)


def test_halves_and_empty(none):
    text = "ab cd " * 50 + "e" * 100 + " f"
    parts = bpe.halves(text, 20)
    assert "".join(parts) == text and 10 <= min(map(len, parts)) <= max(map(len, parts)) <= 20
    assert bpe.halves("", 20) == [""]
    assert bpe.encode_text("", NAME) == []
    assert bpe.join(bpe.Side(b"", []), bpe.Side(b"x", [1]), None, None) == bpe.Side(b"x", [1])
    assert bpe.round_trip(none, NAME).count() == 0
