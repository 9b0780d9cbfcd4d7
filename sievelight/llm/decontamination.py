"""Benchmark decontamination by FM-indexes.

Documents are dealt into shards of bounded size.  A shard's words, numbered in a vocabulary
of its own, are sorted into suffixes; their Burrows-Wheeler transform is held as a wavelet
tree in matrix form, with the text places of sampled suffixes.  The indexes are a written
table.  Windows of the test items are searched backwards through the tree's ranks, all of a
block at a time; occurrences are located by walking to the next sampled suffix, and their
spans are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import Scratch, clear_names, materialise, small_batches, trimmed, unused_names, whole_text
from sievelight.llm.terms import cut_between_words, word_lists, words_of

WINDOW = 10
#: Bytes of text in a shard, about; a longer text is cut into pieces that overlap by a window less one word.
SHARD = 1 << 22
#: Every so many places, a suffix's place is kept.
SAMPLE = 16
#: Windows, and bytes of their words, that are sent to executors together.
BLOCK_WINDOWS, BLOCK_BYTES = 1 << 17, 1 << 24
#: Rows of found sets of items that are broadcast at most.
BROADCAST_ROWS = 100_000


class Bits:
    """A row of bits and the number of ones before any place."""

    def __init__(self, words: np.ndarray):
        self.words = np.append(words, np.uint64(0))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, low = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words."""
    held = np.packbits(bits, bitorder="little")
    return np.concatenate([held, np.zeros(-len(held) % 8, np.uint8)]).view("<u8")


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The places of ``symbols`` in the order of their suffixes; the last symbol, and what ends each text, occurs once.

    Suffixes are sorted by as many symbols as a number holds, then those still equal by
    twice as many each time.
    """
    n = len(symbols)
    width = max(1, int(symbols.max()).bit_length())
    h = max(1, 63 // width)
    key = np.zeros(n, np.int64)
    for k in range(min(h, n)):
        key[: n - k] |= symbols[k:] << (width * (h - 1 - k))
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1], [True]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh[:-1], np.arange(n), 0))
    tied = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
    while len(tied):
        places = order[tied]
        key = (rank[places] << 32) | rank[places + h]
        turn = np.argsort(key)
        order[tied] = places = places[turn]
        key = key[turn]
        fresh = np.concatenate([[True], key[1:] != key[:-1], [True]])
        rank[places] = tied[np.maximum.accumulate(np.where(fresh[:-1], np.arange(len(tied)), 0))]
        tied = tied[~(fresh[:-1] & fresh[1:])]
        h *= 2
    return order


class Index:
    """Finds sequences of symbols (1 to ``sigma``) in a shard's texts.

    ``before`` holds how many suffixes begin with a lesser symbol, ``levels`` the wavelet
    tree of the symbols before each suffix, ``marks`` which suffixes' places ``samples`` has.
    """

    def __init__(self, before: np.ndarray, levels: np.ndarray, marks: np.ndarray, samples: np.ndarray):
        self.before, self.samples, self.marks = before, samples, Bits(marks)
        self.n = int(before[-1])
        depth = len(levels) // max(1, len(marks))
        self.levels = [Bits(x) for x in levels.reshape(depth, -1)]
        self.zeros = [self.n - int(x.ones(np.array([self.n]))[0]) for x in self.levels]

    @staticmethod
    def build(symbols: np.ndarray, sigma: int) -> dict[str, np.ndarray]:
        """The arrays of an index of ``symbols``, where 0 ends each text."""
        ends = np.flatnonzero(symbols == 0)
        distinct = symbols + (len(ends) - 1)
        distinct[ends] = np.arange(len(ends))
        order = suffix_order(distinct)
        before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        current = symbols[order - 1].astype(np.uint32)  # the first text begins after the last one's end
        levels = []
        for bit in reversed(range(max(1, sigma.bit_length()))):
            ones = (current >> np.uint32(bit)) & np.uint32(1) == 1
            levels.append(packed(ones))
            current = np.concatenate([current[~ones], current[ones]])
        kept = np.arange(len(symbols)) % SAMPLE == 0
        kept[0] = True
        kept[ends[:-1] + 1] = True
        marked = kept[order]
        return {
            "before": before.astype(np.int32),
            "levels": np.concatenate(levels),
            "marks": packed(marked),
            "samples": order[marked].astype(np.int32),
        }

    def _down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Ranks of ``symbols`` before ``places`` (a row each)."""
        at = np.concatenate([np.zeros((1, len(symbols)), np.int64), places])
        for k, level in enumerate(self.levels):
            ones = level.ones(at)
            right = (symbols >> (len(self.levels) - 1 - k)) & 1 == 1
            at = np.where(right, self.zeros[k] + ones, at - ones)
        return at[1:] - at[0]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols, the range of suffixes that begin with it."""
        low, high = (self.before[phrases[:, -1] + d].astype(np.int64) for d in (0, 1))
        for k in reversed(range(phrases.shape[1] - 1)):
            left = np.flatnonzero(high > low)
            symbols = phrases[left, k]
            ranks = self._down(symbols, np.stack([low[left], high[left]]))
            low[left], high[left] = self.before[symbols] + ranks
        return low, high

    def places(self, suffixes: np.ndarray) -> np.ndarray:
        """Where in the texts these suffixes begin."""
        out = np.empty(len(suffixes), np.int64)
        left, at, steps = np.arange(len(suffixes)), suffixes.astype(np.int64), 0
        while len(left):
            known = self.marks.at(at)
            out[left[known]] = self.samples[self.marks.ones(at[known])] + steps
            left, at, steps = left[~known], at[~known], steps + 1
            at = self._back(at)
        return out

    def _back(self, suffixes: np.ndarray) -> np.ndarray:
        """The suffixes that begin one symbol earlier."""
        at = np.stack([np.zeros_like(suffixes), suffixes])
        symbols = np.zeros_like(suffixes)
        for k, level in enumerate(self.levels):
            right = level.at(at[1])
            ones = level.ones(at)
            symbols = 2 * symbols + right
            at = np.where(right, self.zeros[k] + ones, at - ones)
        return self.before[symbols] + at[1] - at[0]


_PIECES = [("row_key", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("fresh", pa.int64()), ("size", pa.int64())]
_INDEX = (
    "pieces array<struct<row_key: long, doc_id: long, first: long, fresh: long, size: long>>, vocabulary array<string>, "
    "before binary, levels binary, marks binary, samples binary"
)


def _long_pieces(text: str, overlap: int) -> Iterator[tuple[str, int, int]]:
    """Parts of a text that end between words, each with the words before it that a window may reach back to.

    With each part go the number of the first word and how many of its words are new.
    """
    done, tail = 0, []
    for part in cut_between_words(text, SHARD):
        words, _ = words_of(pa.array([part]))
        yield " ".join([*tail, part]), done - len(tail), len(words)
        done += len(words)
        tail = [*tail, *words[max(0, len(words) - overlap) :].to_pylist()][-overlap:] if overlap else []


def _shards(rows: Iterator[tuple[int, int | None, str]], overlap: int) -> Iterator[list[tuple]]:
    """Pieces (row key, id, text, first word, new words or -1 for all) of shards of bounded size."""
    held, size = [], 0
    for key, doc, text in rows:
        pieces = [(text, 0, -1)] if len(text) <= SHARD else _long_pieces(text, overlap)
        for piece, first, fresh in pieces:
            if held and size + len(piece) > SHARD:
                yield held
                held, size = [], 0
            held.append((key, doc, piece, first, fresh))
            size += len(piece)
    if held:
        yield held


def _index_row(shard: list[tuple]) -> pa.RecordBatch:
    keys, docs, texts, first, fresh = zip(*shard, strict=True)
    words, starts = words_of(pa.array(texts, pa.string()))
    coded = words.dictionary_encode()
    size = np.diff(starts)
    symbols = np.zeros(len(words) + len(texts), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[starts[1:] + np.arange(len(texts))] = False
    symbols[inside] = coded.indices.to_numpy(zero_copy_only=False) + 1
    held = Index.build(symbols, len(coded.dictionary))
    columns = [keys, docs, first, np.where(np.array(fresh) < 0, size, fresh), size]
    pieces = pa.StructArray.from_arrays(
        [pa.array(c, k) for c, (_, k) in zip(columns, _PIECES, strict=True)], names=[name for name, _ in _PIECES]
    )
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [one(pieces), one(coded.dictionary.cast(pa.string())), *(pa.array([v.tobytes()], pa.binary()) for v in held.values())],
        names=["pieces", "vocabulary", *held],
    )


def index_documents(
    docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """A row for each shard: its pieces of texts and the FM-index of their words, for windows of up to ``window`` words.

    Every row of ``docs`` is in a shard, those without words too.  It is to be written
    before it is searched, as it numbers rows anew each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for shard in _shards(rows, window - 1):
            yield _index_row(shard)

    return small_batches(docs).select(
        F.monotonically_increasing_id().alias("row_key"), F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")
    ).mapInArrow(trimmed(run), _INDEX)


def item_windows(
    items: DataFrame, scratch: Scratch, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The windows of all items (words, group), and the items of each group (group, item).

    Windows that occur in the same items form a group.  An item shorter than a window is
    one; repeated ids are one item, and so are rows without an id.  No list of a window's
    items is gathered: groups are told by the number of their items and two sums of hashes.
    """
    n, words = F.size("words"), F.col("words")
    slices = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1)), lambda i: F.slice(words, i, window))
    pairs = word_lists(items, id_column, text_column).filter(n > 0).select(
        F.col("id").alias("item"), F.explode(slices).alias("words")
    )
    pairs = scratch.keep(pairs.distinct(), "pairs")
    hashed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "item"))
    windows = pairs.groupBy("words").agg(
        F.struct(F.count(F.lit(1)), hashed("one"), hashed("two")).alias("held_by")
    ).withColumn("number", F.monotonically_increasing_id())
    windows = scratch.keep(windows, "numbered")
    groups = windows.groupBy("held_by").agg(F.min("number").alias("group"))
    windows = scratch.keep(windows.join(groups, "held_by").select("words", "number", "group"), "windows")
    firsts = windows.filter(F.col("number") == F.col("group")).select("words", "group")
    return windows.select("words", "group"), scratch.keep(pairs.join(firsts, "words").select("group", "item"), "items")


def _blocks(windows: DataFrame) -> Iterator[DataFrame]:
    """``windows`` in blocks of bounded size, by hash."""
    count, size = windows.agg(F.count(F.lit(1)), F.sum(F.length(F.array_join("words", " ")))).first()
    n = 1 + max(count // BLOCK_WINDOWS, (size or 0) // BLOCK_BYTES)
    for k in range(n if count else 0):
        yield windows.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == k)


def _found(row: dict, phrases: dict[int, tuple[np.ndarray, np.ndarray]], vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """Piece, first word, end and group of each occurrence in a shard."""
    index = Index(
        np.frombuffer(row["before"], np.int32),
        np.frombuffer(row["levels"], "<u8"),
        np.frombuffer(row["marks"], "<u8"),
        np.frombuffer(row["samples"], np.int32),
    )
    own = pc.index_in(vocabulary, value_set=row["vocabulary"].cast(vocabulary.type))
    symbols = pc.fill_null(own, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    size, first = (row["pieces"].field(f).to_numpy(zero_copy_only=False) for f in ("size", "first"))
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    out = [[np.zeros(0, np.int64)] for _ in range(4)]
    for length, (words, groups) in phrases.items():
        there = np.flatnonzero((symbols[words] > 0).all(axis=1))
        low, high = index.ranges(symbols[words[there]]) if len(there) else (there, there)
        n = np.maximum(high - low, 0)
        suffixes = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places = index.places(suffixes)
        piece = np.searchsorted(starts, places, side="right") - 1
        begin = first[piece] + places - starts[piece]
        for held, values in zip(out, (piece, begin, begin + length, np.repeat(groups[there], n)), strict=True):
            held.append(values)
    return tuple(np.concatenate(x) for x in out)


def _merged(piece: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, begin and end of the spans that remain when those of a piece that touch are one."""
    if not len(piece):
        return piece, begin, end
    order = np.lexsort((begin, piece))
    piece, begin, end = piece[order], begin[order], end[order]
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(piece * far + end)
    fresh = np.flatnonzero(np.r_[True, piece[1:] * far + begin[1:] > reach[:-1]])
    last = np.r_[fresh[1:], len(piece)] - 1
    return piece[fresh], begin[fresh], reach[last] - piece[last] * far


_SPANS = "array<struct<begin: long, end: long>>"


def _search(phrases, vocabulary, counts_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_length = vocabulary.value, phrases.value
        names = ("before", "levels", "marks", "samples")
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_buffer() for name in names}
                row |= {name: batch.column(name)[k].values for name in ("pieces", "vocabulary")}
                piece, begin, end, group = _found(row, by_length, known)
                n = len(row["pieces"])
                lists = lambda at, values: pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32()), values
                )
                pairs = np.unique(np.stack([piece, group]), axis=1)
                at, lo, hi = _merged(piece, begin, end)
                spans = lists(at, pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], names=["begin", "end"]))
                fresh = row["pieces"].field("fresh") if counts_words else pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [row["pieces"].field("row_key"), row["pieces"].field("doc_id"), fresh, spans, lists(pairs[0], pa.array(pairs[1]))],
                    names=["row_key", "doc_id", "fresh", "spans", "groups"],
                )

    return run


def search_index(index: DataFrame, windows: DataFrame) -> DataFrame:
    """row_key, doc_id, n_words, spans and groups of every row in ``index`` (written).

    Spans are the merged places of windows, as first word and end; groups are those of the
    windows found, in order.
    """
    sc = index.sparkSession.sparkContext
    parts = []
    for block in _blocks(windows):
        rows = block.toArrow()
        words = rows.column("words").combine_chunks()
        coded = words.flatten().dictionary_encode()
        codes, sizes = coded.indices.to_numpy(), pc.list_value_length(words).to_numpy()
        groups, starts = rows.column("group").to_numpy(), np.cumsum(sizes) - sizes
        phrases = {}
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            phrases[int(n)] = (codes[starts[own][:, None] + np.arange(n)], groups[own])
        run = _search(sc.broadcast(phrases), sc.broadcast(coded.dictionary), not parts)
        parts.append(index.mapInArrow(trimmed(run), f"row_key long, doc_id long, fresh long, spans {_SPANS}, groups array<long>"))
    if not parts:
        pieces = index.select(F.explode("pieces").alias("p")).select("p.row_key", "p.doc_id", "p.fresh")
        parts = [pieces.selectExpr("*", f"cast(array() as {_SPANS}) as spans", "cast(array() as array<long>) as groups")]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    own = found.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("fresh").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups"),
    )
    # Spans of several pieces or blocks may touch still.
    merged = F.expr(f"""
        aggregate(spans, cast(array() as {_SPANS}), (held, x) -> if(
            size(held) > 0 and x.begin <= element_at(held, -1).end,
            concat(slice(held, 1, size(held) - 1), array(named_struct(
                'begin', element_at(held, -1).begin, 'end', greatest(element_at(held, -1).end, x.end)))),
            concat(held, array(x))))""")
    several = F.expr("exists(sequence(2, greatest(2, size(spans))), k -> get(spans, k - 1).begin <= get(spans, k - 2).end)")
    return own.withColumn("spans", F.when(several, merged).otherwise(F.col("spans")))


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """A row for each document: row_key, doc_id, n_words, spans, n_hit, n_items and item_ids.

    A window is ``window`` consecutive words of an item, or all of one that is shorter.
    Spans (first word and end) cover each place in the whole text where a window occurs, and n_hit counts
    their words.  item_ids are the items with such windows, sorted as strings.
    Null and empty texts have no words, nor spans.  Repeated rows and rows without an id
    have a row each.  Items without words occur nowhere; rows of ``items`` with the same
    id are one item, those without an id one whose id is written as nothing.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    index = scratch.keep(index_documents(docs, window, id_column, text_column), "index")
    windows, held = item_windows(items, scratch, window)
    placed = scratch.keep(search_index(index, windows), "placed")
    scratch.drop_all_but("placed", "items")
    hit = placed.filter(F.size("groups") > 0)
    # Each distinct set of groups is turned into items once, however many documents have it.
    sets = scratch.keep(hit.select("groups").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
    names = sets.select("set", F.explode("groups").alias("group")).join(held, "group").groupBy("set").agg(
        F.array_sort(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("item_ids")
    )
    named = scratch.keep(sets.join(names, "set").select("groups", "item_ids"), "named")
    few = named.count() <= BROADCAST_ROWS
    hit = hit.join(F.broadcast(named) if few else named, "groups").drop("groups")
    clean = placed.filter(F.size("groups") == 0).drop("groups").withColumn("item_ids", F.expr("cast(array() as array<string>)"))
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.begin)")
    return hit.unionByName(clean).select(
        "row_key", "doc_id", "n_words", "spans", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids"
    )


_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between those of one span."""
    out, last, words, at = [], 0, _WORD.finditer(text), 0
    for begin, end in spans:
        for word in words:
            at += 1
            if at - 1 == begin:
                out.append(text[last : word.start()])
            if at == end:
                last = word.end()
                break
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with all their columns; found passages are cut out of the text.

    Rows are told apart by a written key.  A null text stays null.
    """
    row, gone, spans_name = unused_names(docs, "row_key", "gone_key", "spans")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-keyed")
    found = contamination(keyed.select(F.col(row).alias("doc_id"), F.col(text_column).alias("text")), items, window)
    found = found.filter("n_hit > 0").select(F.col("doc_id").alias(gone), F.col("spans").alias(spans_name))
    joined = keyed.join(found, keyed[row] == F.col(gone), "left")
    names = docs.columns
    at = names.index(text_column)
    text, held = clear_names(names, "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(len(names)), batch.column(at)
            if spans.null_count < len(spans):
                new = [
                    t if s is None or t is None else cut(t, [(x["begin"], x["end"]) for x in s])
                    for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)
                ]
                texts = pa.array(new, texts.type)
            columns = [texts if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(joined.select(*names, spans_name)).mapInArrow(run, docs.schema)
