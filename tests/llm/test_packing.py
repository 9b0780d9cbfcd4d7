from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np

from sievelight.llm import packing
from sievelight.llm.bpe import codec

NAME = "byte_bpe_50k.json"


def check(rows, texts, capacity):
    own = codec(NAME)
    want = defaultdict(int)
    for doc, text in texts:
        ids = np.asarray([*own.encode(text or ""), 2], "<u4")
        for k, (s, n) in enumerate(packing.pieces_of(len(ids), capacity)):
            want[doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    got = defaultdict(int)
    held = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        held[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return held


def test_pieces():
    assert packing.pieces_of(10, 10) == [(0, 10)]
    assert packing.pieces_of(25, 10) == [(0, 5), (5, 10), (15, 10)]
    assert packing.pieces_of(20, 10) == [(0, 10), (10, 10)]


def test_odd_documents(odd, odd_texts):
    check(packing.pack_documents(odd, NAME, 64).collect(), odd_texts, 64)


def test_genetic_algorithm_is_no_worse_than_best_fit():
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 99), rng.randint(30, 60)]) for _ in range(400)]
    order = sorted(range(400), key=lambda k: -lengths[k])
    plain = packing.best_fit(order, lengths, [], 100)
    best = packing.evolve(lengths, 100, 1, [], generations=30)[0]
    assert sorted(k for held in best for k in held) == list(range(400))
    assert all(sum(lengths[k] for k in held) <= 100 for held in best)
    assert packing.fitness(best, lengths, 100) >= packing.fitness(plain, lengths, 100)


def test_crossover_keeps_every_item_once():
    rng = random.Random(5)
    lengths = [rng.randint(1, 99) for _ in range(120)]
    one, other = (packing.best_fit(rng.sample(range(120), 120), lengths, [], 100) for _ in range(2))
    child = packing.crossover(one, other, lengths, 100, rng)
    assert sorted(k for held in child for k in held) == list(range(120))
    assert all(sum(lengths[k] for k in held) <= 100 for held in child)


def test_several_blocks_and_sequences(spark):
    rng = random.Random(9)
    texts = [(k, " ".join(["word"] * rng.randint(0, 60))) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = packing.tokens(docs, NAME, 64).selectExpr("doc_id * 10 + piece as item", "length").cache()
    placed = packing.pack_lengths(items, 64, block=50)
    assert placed.count() == items.count() == placed.select("item").distinct().count()
    packed = packing.pack_documents(docs, NAME, 64)
    held = check(packed.collect(), texts, 64)
    total = sum(n for parts in held.values() for _, n in parts)
    assert len(held) <= 1.05 * -(-total // 64)
    ids = {r.sequence_id: list(r.ids) for r in packing.sequences(docs, packed, NAME, 64).collect()}
    assert {k: len(v) for k, v in ids.items()} == {k: sum(n for _, n in v) for k, v in held.items()}


def test_query_against_the_library(spark):
    """Every piece of every document of the query, by the library's own ids; few sequences more than the tokens need."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from sievelight.llm import queries

    sf = "/root/testdata/sf0.01"
    own = Tokenizer.from_file(public_tokenizers.path(NAME))
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {}
    for doc, text in texts:
        ids = np.asarray([*own.encode(text, add_special_tokens=False).ids, 2], "<u4")
        starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[doc, k] = (s, e - s, zlib.crc32(ids[s:e].tobytes()))
    rows = queries.op5_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    held = check(rows, texts, 1024)
    assert len(held) <= 1.02 * -(-sum(n for _, n, _ in want.values()) // 1024)


def test_empty(none):
    assert packing.pack_documents(none, NAME).count() == 0
