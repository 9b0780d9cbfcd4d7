"""Ranked lexical search by a bit-sliced impact index.

What a term adds to a document's score, its impact, is a whole number.  For a block of
documents, a term's impacts are held as bitmaps, one for each bit, with a bit for each
document.  A query adds its terms' bitmaps as numbers are added by hand, with carries, for
all documents of a block at once; the highest scores are found from the most significant
bitmap down, where documents that have a bit come before those that don't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.common import Scratch, small_batches, trimmed, whole_text
from sievelight.llm.terms import parts, word_lists, words_of

TOP = 50
#: Terms of items that are looked up in one pass over the documents, about, and bytes of them.
BLOCK_TERMS, BLOCK_BYTES = 1 << 18, 1 << 24
#: Documents of a block of bitmaps.
DOCUMENTS = 1 << 14
#: Bitmaps of terms that several items use are kept for a block up to so many bytes.
KEPT_BYTES = 1 << 26
#: Bytes of text whose words are looked at together.
TEXT_BYTES = 1 << 22


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item and term, each pair once; rows with the same id, or without one, are one item."""
    return word_lists(items, id_column, text_column).select(F.col("id").alias("item"), F.explode("words").alias("term")).distinct()


def _blocks(pairs: DataFrame) -> Iterator[pa.Table]:
    """item and terms of all items, in blocks of bounded size by hash; an item is in one block."""
    count, size = pairs.agg(F.count(F.lit(1)), F.sum(F.length("term"))).first()
    n = 1 + max(count // BLOCK_TERMS, (size or 0) // BLOCK_BYTES)
    for k in range(n if count else 0):
        block = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toArrow()
        if block.num_rows:
            yield block


def postings(docs: DataFrame, terms: pa.Array, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_terms, terms and counts of every row: how often its whole text has which of ``terms``, by number."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        width = max(1, len(known))
        for batch in batches:
            n_terms = np.zeros(batch.num_rows, np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, texts in parts(batch.column(1), TEXT_BYTES):
                words, starts = words_of(texts)
                sizes = np.diff(starts)
                np.add.at(n_terms, rows, sizes)
                coded = words.dictionary_encode()
                number = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1)
                number = number.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
                found = (np.repeat(rows, sizes) * width + number)[number >= 0]
                key, n = np.unique(found, return_counts=True)
                keys.append(key)
                counts.append(n)
            key, place = np.unique(np.concatenate(keys), return_inverse=True)  # a long text comes in several parts
            n = np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)
            at = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * width), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_terms),
                    pa.ListArray.from_arrays(at, pa.array(key % width, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(n)),
                ],
                names=["doc_id", "n_terms", "terms", "counts"],
            )

    return small_batches(docs).select(
        F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")
    ).mapInArrow(trimmed(run), "doc_id long, n_terms long, terms array<int>, counts array<long>")


def weights(n_documents: int, holding: np.ndarray) -> np.ndarray:
    """A term's weight from how many documents hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(n) + 1))) for n in holding], np.int64)


def impacts(weight: np.ndarray, count: np.ndarray, length: np.ndarray, n_documents: int, n_words: int) -> np.ndarray:
    """What terms add to the scores of documents of ``length`` terms that have them ``count`` times."""
    m = 100 - 50 + (50 * length * n_documents) // n_words
    return weight * ((1_000_000_000 * count) // (1000 * count + 20 * m))


def bitmaps(places: np.ndarray, values: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of ``words`` 64-bit words for each bit of ``values``, the least first; ``places`` ascend."""
    depth = int(values.max(initial=0)).bit_length()
    out = np.zeros((depth, words), np.uint64)
    if depth:
        one = np.uint64(1) << (places & 63).astype(np.uint64)
        word = places >> 6
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        bits = (values.astype(np.uint64) >> np.arange(depth, dtype=np.uint64)[:, None]) & np.uint64(1)
        out[:, word[first]] = np.bitwise_or.reduceat(bits * one, first, axis=1)
    return out


def add(total: list[np.ndarray], more: np.ndarray) -> None:
    """Adds the numbers of ``more`` to those of ``total``, bitmap by bitmap, with the carry of each to the next."""
    carry = None
    for k in range(max(len(total), len(more))):
        if k == len(total):
            total.append(np.zeros_like(more[0]))
        if k < len(more):
            a, b = total[k], more[k]
            either = a ^ b
            if carry is None:
                total[k], carry = either, a & b
            else:
                total[k], carry = either ^ carry, (a & b) | (either & carry)
        else:
            if not carry.any():
                return
            total[k], carry = total[k] ^ carry, total[k] & carry
    if carry is not None and carry.any():
        total.append(carry)


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def highest(total: list[np.ndarray], k: int) -> np.ndarray:
    """The places of the ``k`` highest numbers above 0, the first ones of equal numbers."""
    if not total:
        return np.zeros(0, np.int64)
    count = lambda x: int(np.bitwise_count(x).sum())
    maybe = np.bitwise_or.reduce(total)
    sure = np.zeros_like(maybe)
    for bitmap in reversed(total):
        have = maybe & bitmap
        n = count(sure) + count(have)
        if n > k:
            maybe = have
        else:
            sure, maybe = sure | have, maybe & ~bitmap
            if n == k:
                return _places(sure)
    # What is left has equal numbers.
    return np.sort(np.concatenate([_places(sure), _places(maybe)[: k - count(sure)]]))


def values_at(total: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    out = np.zeros(len(places), np.int64)
    for k, bitmap in enumerate(total):
        out |= ((bitmap[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k
    return out


class Block:
    """Bitmaps of the terms of some documents, made as they are asked for."""

    def __init__(self, rows: list[pa.RecordBatch], weight: np.ndarray, n_documents: int, n_words: int):
        table = pa.Table.from_batches(rows).combine_chunks()
        doc = table.column("doc_id")
        table = table.take(pc.sort_indices(doc, null_placement="at_end"))  # so the first of equal scores has the least id
        self.ids = table.column("doc_id").combine_chunks()
        length = table.column("n_terms").to_numpy()
        terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
        owner = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)
        term, count = (x.flatten().to_numpy(zero_copy_only=False) for x in (terms, counts))
        order = np.argsort(term, kind="stable")
        term, self.places = term[order], owner[order].astype(np.int64)
        self.values = impacts(weight[term], count[order], length[self.places], n_documents, n_words)
        self.starts = np.searchsorted(term, np.arange(len(weight) + 1))
        self.words = -(-len(self.ids) // 64)
        self.kept: dict[int, np.ndarray] = {}
        self.room = KEPT_BYTES

    def of(self, term: int, keep: bool) -> np.ndarray:
        found = self.kept.get(term)
        if found is None:
            at = slice(self.starts[term], self.starts[term + 1])
            found = bitmaps(self.places[at], self.values[at], self.words)
            if keep and found.nbytes <= self.room:
                self.kept[term] = found
                self.room -= found.nbytes
        return found

    def search(self, terms: np.ndarray, shared: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` highest documents."""
        total: list[np.ndarray] = []
        for t in terms:
            if self.starts[t] < self.starts[t + 1]:
                add(total, self.of(t, shared[t]))
        places = highest(total, k)
        return places, values_at(total, places)


def _best(doc: pa.Array, score: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    order = pc.sort_indices(
        pa.table({"score": score, "doc": doc}), sort_keys=[("score", "descending"), ("doc", "ascending")], null_placement="at_end"
    )[:k]
    return doc.take(order), score[order.to_numpy()]


def _search_block(docs: DataFrame, block: pa.Table, k: int, scratch: Scratch, names: tuple[str, str], schema: str) -> DataFrame:
    """item, doc_id and score, as in ``schema``: the highest of each item of ``block``, or more."""
    sc = docs.sparkSession.sparkContext
    coded = block.column("term").combine_chunks().dictionary_encode()
    held = scratch.keep(postings(docs, coded.dictionary, *names), "postings")
    totals = held.agg(F.sum((F.col("n_terms") > 0).cast("long")), F.sum("n_terms"), F.count(F.lit(1))).first()
    n_documents, n_words, rows = (x or 0 for x in totals)
    found = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row for each term of the block
    holding = np.zeros(len(coded.dictionary), np.int64)
    holding[found.column("term").to_numpy()] = found.column("count").to_numpy()
    items = block.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
    order = np.argsort(items.indices.to_numpy(), kind="stable")
    term = coded.indices.to_numpy()[order]
    starts = np.searchsorted(items.indices.to_numpy()[order], np.arange(len(items.dictionary) + 1))
    shared = np.bincount(term, minlength=len(holding)) > 1
    sent = sc.broadcast((items.dictionary, starts, term, shared, weights(n_documents, holding)))
    kind = block.schema.field("item").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, starts, term, shared, weight = sent.value
        best: dict[int, tuple[pa.Array, np.ndarray]] = {}

        def search(rows: list[pa.RecordBatch]) -> None:
            index = Block(rows, weight, n_documents, n_words)
            for j in range(len(item)):
                places, score = index.search(term[starts[j] : starts[j + 1]], shared, k)
                if len(places):
                    doc = index.ids.take(pa.array(places))
                    if j in best:
                        doc, score = pa.concat_arrays([best[j][0], doc]), np.concatenate([best[j][1], score])
                    best[j] = _best(doc, score, k)

        rows, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(lo, DOCUMENTS)
                if n + part.num_rows > DOCUMENTS:
                    search(rows)
                    rows, n = [], 0
                rows.append(part)
                n += part.num_rows
        if rows and n_words:
            search(rows)
        for j, (doc, score) in best.items():
            numbers = pa.array(np.full(len(doc), j), pa.int32())
            yield pa.RecordBatch.from_arrays([item.take(numbers).cast(kind), doc, pa.array(score)], names=["item", "doc_id", "score"])

    least = max(sc.defaultParallelism, -(-rows // DOCUMENTS))
    return scratch.keep(held.coalesce(least).mapInArrow(trimmed(run), schema), "highest")


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id"
) -> DataFrame:
    """item_id, rank, doc_id and score: each item's ``k`` highest documents with a score above 0, or all if there are fewer.

    Every row of ``docs`` is a document, repeated ones too; one without words, or with a
    null text, scores 0.  Equal scores go by ascending doc_id, null last.  An item's terms
    count once; rows of ``items`` with the same id, or without one, are one item, and
    items without words, or whose words no document holds, have no rows.  Items are
    dealt into blocks of bounded size, each of which is one pass over the documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical-search")
    pairs = scratch.keep(item_terms(items, item_column), "terms")
    schema = f"item {items.schema[item_column].dataType.simpleString()}, doc_id long, score long"
    found = [_search_block(docs, block, k, scratch, (id_column, text_column), schema) for block in _blocks(pairs)]
    out = spark.createDataFrame([], schema)
    for part in found:
        out = out.union(part)
    scratch.drop_all_but("highest")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
