"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Pieces are dealt at random into blocks of bounded size.  Each block is packed by several
islands: an individual is a list of sequences, the crossover injects whole well-filled
sequences of one parent into the other, removes the sequences that then hold a piece
twice, exchanges displaced pieces for shorter ones where that fills a gap, and best-fits
the rest.  After each epoch every island sends its elite to the next one.  Work and memory
of a task depend on the block size alone.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.bpe import codec
from sievelight.llm.common import materialise, small_batches, trimmed, whole_text

BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 20
ELITE = 2
#: Sequences at least this full count as well filled.
WELL_FILLED = 0.995

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` tokens: only the first may be shorter than ``capacity``."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(items, lengths, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Puts each item into the fullest bin that still takes it; opens a bin if none does."""
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0
    for k, held in enumerate(bins):
        gap = capacity - sum(map(lengths.__getitem__, held))
        at_gap[gap].append(k)
        gaps |= 1 << gap
    for item in items:
        need = lengths[item]
        fits = gaps >> need
        if fits:
            gap = need + (fits & -fits).bit_length() - 1
            k = at_gap[gap].pop()
            if not at_gap[gap]:
                gaps ^= 1 << gap
            bins[k].append(item)
        else:
            gap, k = capacity, len(bins)
            bins.append([item])
        gap -= need
        at_gap[gap].append(k)
        gaps |= 1 << gap
    return bins


def fitness(bins: list[list[int]], lengths, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller and emptier ones rather than even ones."""
    return -len(bins), sum((sum(map(lengths.__getitem__, held)) / capacity) ** 2 for held in bins)


def replace(bins: list[list[int]], displaced: list[int], lengths, capacity: int) -> list[int]:
    """Fills gaps by exchanging an item of a bin for the longest displaced one that fits; what is left, by rising length."""
    free = sorted(displaced, key=lengths.__getitem__)
    sizes = [lengths[item] for item in free]
    for held in bins:
        gap = capacity - sum(map(lengths.__getitem__, held))
        for k, item in enumerate(held):
            if not gap:
                break
            size = lengths[item]
            at = bisect(sizes, size + gap) - 1
            if at >= 0 and sizes[at] > size:
                held[k] = free.pop(at)
                gap -= sizes.pop(at) - size
                at = bisect(sizes, size)
                sizes.insert(at, size)
                free.insert(at, item)
    return free


def crossover(
    one: list[list[int]], other: list[list[int]], lengths, capacity: int, rng: random.Random
) -> list[list[int]]:
    """``one`` with whole well-filled bins of ``other``."""
    full = [held for held in other if sum(map(lengths.__getitem__, held)) >= WELL_FILLED * capacity] or other
    chosen = [list(held) for held in full if rng.random() < 0.5]
    injected = {item for held in chosen for item in held}
    stay, displaced = [], []
    for held in one:
        if injected.isdisjoint(held):
            stay.append(list(held))
        else:
            displaced += [item for item in held if item not in injected]
    # The least filled bins are dealt anew too; without that a single item could never move.
    stay.sort(key=lambda held: -sum(map(lengths.__getitem__, held)))
    anew = max(1, len(stay) // 50) if stay else 0
    for held in stay[len(stay) - anew :]:
        displaced += held
    stay = stay[: len(stay) - anew]
    left = replace(stay, displaced, lengths, capacity)
    return chosen + best_fit(reversed(left), lengths, stay, capacity)


def evolve(
    lengths: list[int], capacity: int, seed: int, population: list[list[list[int]]], generations: int = GENERATIONS
) -> list[list[list[int]]]:
    """Population after some generations, best first; it stops early at the least conceivable number of bins."""
    rng = random.Random(seed)
    order = sorted(range(len(lengths)), key=lambda item: -lengths[item])
    least = -(-sum(lengths) // capacity)
    score = lambda bins: fitness(bins, lengths, capacity)
    while len(population) < POPULATION:
        if population:
            near = sorted(order, key=lambda item: -lengths[item] * rng.uniform(0.9, 1.1))
        population.append(best_fit(order if not population else near, lengths, [], capacity))
        if len(population[-1]) <= least:
            return [population[-1]]
    population.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(population[0]) <= least:
            break
        one, other = rng.sample(population, 2)
        child = crossover(one, other, lengths, capacity, rng)
        if score(child) > score(population[-1]):
            population[-1] = child
            population.sort(key=score, reverse=True)
    return population


_ISLAND = "block long, island int, elite int, bins_n int, fill double, items array<long>, lengths array<int>, bins array<int>"


def _row(block, island, rank, bins, items, lengths, capacity) -> dict:
    where = np.empty(len(items), np.int32)
    for k, held in enumerate(bins):
        where[held] = k
    n, fill = fitness(bins, lengths, capacity)
    return {
        "block": block,
        "island": island,
        "elite": rank,
        "bins_n": -n,
        "fill": fill,
        "items": items,
        "lengths": np.asarray(lengths, np.int32),
        "bins": where,
    }


def _first_epoch(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item")
        block, island = int(group["block"].iloc[0]), int(group["island"].iloc[0])
        lengths = group["length"].astype(int).tolist()
        best = evolve(lengths, capacity, block * 31 + island, [])[:ELITE]
        return pd.DataFrame(
            [_row(block, island, k, bins, group["item"].to_numpy(), lengths, capacity) for k, bins in enumerate(best)]
        )

    return run


def _later_epoch(capacity: int, epoch: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bins_n", "fill"], ascending=[True, False])
        block, island = int(group["block"].iloc[0]), int(group["island"].iloc[0])
        items, lengths = group["items"].iloc[0], group["lengths"].iloc[0].tolist()
        own = []
        for where in group["bins"]:
            bins: list[list[int]] = [[] for _ in range(int(where.max()) + 1)]
            for item, k in enumerate(where.tolist()):
                bins[k].append(item)
            own.append(bins)
        best = evolve(lengths, capacity, (epoch << 40) + block * 31 + island, own)[:ELITE]
        return pd.DataFrame([_row(block, island, k, bins, items, lengths, capacity) for k, bins in enumerate(best)])

    return run


def _place(group: pd.DataFrame) -> pd.DataFrame:
    """Items, sequences and offsets of the best individual of a block."""
    best = group.sort_values(["bins_n", "fill", "island"], ascending=[True, False, True]).iloc[0]
    order = np.lexsort((best["items"], best["bins"]))
    bins, lengths = best["bins"][order], best["lengths"][order].astype(np.int64)
    before = np.cumsum(lengths) - lengths
    first = np.r_[True, bins[1:] != bins[:-1]]
    offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
    return pd.DataFrame(
        {
            "item": best["items"][order],
            "sequence_id": 2 * ((int(best["block"]) << 20) + bins.astype(np.int64)),
            "offset": offset,
        }
    )


def tokens(
    docs: DataFrame,
    vocabulary: str,
    capacity: int,
    end_id: int = 2,
    text_column: str = "text",
    id_column: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[], [], [], [], [], []]
                for doc, text in zip(
                    batch.column(0).slice(lo, 256).to_pylist(), batch.column(1).slice(lo, 256).to_pylist(), strict=True
                ):
                    ids = np.asarray([*own.encode(text), end_id], "<u4")
                    for k, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                        part = ids[start : start + n]
                        for column, value in zip(
                            out,
                            (doc, k, start, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None),
                            strict=True,
                        ):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                columns = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                )

    return small_batches(docs).select(
        F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")
    ).mapInArrow(trimmed(run), PIECES + ", ids array<int>" * with_ids)


def pack_lengths(items: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """Packs ``items`` (item long, unique; length from 1 to ``capacity``): item, sequence_id, offset.

    An empty table gives no rows.  Numbers of sequences are unique and have gaps.
    """
    short = items.filter(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // block))
    dealt = short.select(
        "item",
        "length",
        F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"),
        F.explode(F.lit(list(range(ISLANDS)))).alias("island"),
    )
    elites = dealt.groupBy("block", "island").applyInPandas(_first_epoch(capacity), _ISLAND)
    for epoch in range(1, EPOCHS):
        elites = materialise(elites, "packing-elites")
        migrants = elites.filter("elite = 0").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        elites = elites.unionByName(migrants).groupBy("block", "island").applyInPandas(
            _later_epoch(capacity, epoch), _ISLAND
        )
    placed = elites.filter("elite = 0").groupBy("block").applyInPandas(
        _place, "item long, sequence_id long, offset long"
    )
    full = items.filter(F.col("length") >= capacity).select(
        "item", (2 * F.col("item") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(full)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 1024,
    end_id: int = 2,
    text_column: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """Where every piece of every document goes.

    A document is its token ids and ``end_id``; null text counts as empty and is a piece
    of one token.  Longer ones than ``capacity`` are cut into pieces of which only the
    first may be shorter.  Rows that repeat an id are packed each on its own; a null id
    stays null.  Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    items = materialise(
        tokens(
            docs, vocabulary, capacity, end_id, text_column, id_column
        ).withColumn("item", F.monotonically_increasing_id()),
        "packing-pieces",
    )
    return items.join(pack_lengths(items.select("item", "length"), capacity), "item").drop("item")


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids.  Ids of documents must be unique and not null."""
    parts = tokens(docs, vocabulary, capacity, end_id, with_ids=True).join(
        packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"]
    )
    held = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", F.flatten(F.transform("held", lambda part: part["ids"])).alias("ids"))
