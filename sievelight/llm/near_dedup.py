"""Near duplicates by MinHash with one permutation and optimal densification.

A document's distinct word shingles are hashed once; the least hash in each of
``BINS`` ranges is its sketch, and an empty range copies a range chosen by a hash of the
range and the attempt until one is not empty.  Bands of the sketch are bucket keys.
Documents with equal shingle sets count as one node.  In each bucket every node is
compared with the bucket's centre alone, which bounds the pairs by nodes times bands; links
are confirmed on the full sets.

A bucket whose nodes do not all come to lie in one component may hold links that its
centre doesn't show.  Its nodes meet in bounded blocks of similar set sizes, by the numbers
of their shingles in each range alone: the sum of the lesser numbers is as much as two sets
can have in common, so what it rules out is no link.  Pairs of different components that it
leaves are confirmed on the full sets, like the centres' pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import Scratch, materialise, small_batches, trimmed, unused_names, whole_text
from sievelight.llm.components import components

BINS = 256
BAND = 6
BANDS = BINS // BAND
#: Nodes of a bucket and size class, on average, in a block: these at least, more where that makes over SPREAD blocks, these at most.
BLOCK, MOST_BLOCK = 512, 8192
SPREAD = 32
#: Rows at most that are broadcast to find the texts of candidates.
BROADCAST_ROWS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time.
SLICE = 1 << 18
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes after lower-casing as random numbers, the white space, and the values of attempts."""
    low = np.arange(256)
    low[65:91] += 32
    numbers = _mix((low.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER)
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return numbers, space, _mix(np.arange(BINS, dtype=np.uint64) * _MULTIPLIER)


@lru_cache(maxsize=1)
def _slice_powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    return tuple(
        np.cumprod(np.full(2 * SLICE, np.uint64(x))) for x in (base, pow(base, -1, 1 << 64))
    )


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    powers, shifts = _slice_powers()
    while len(powers) < n:
        powers, shifts = (np.concatenate([x, x * x[-1]]) for x in (powers, shifts))
    return powers[:n], shifts[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, A-Z lower-cased, and the text of each."""
    numbers, space, _ = _tables()
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = space[data]
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    # A word's hash is a polynomial in the places of its bytes: one subtraction of sums, shifted to the front.
    powers, shifts = _powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(numbers[data] * powers)])
    return _mix((sums[end] - sums[start]) * shifts[start] + (end - start).astype(np.uint64) * _MULTIPLIER), owner


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``k`` words; with fewer words, of the whole sequence."""
    batch, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if batch and size + len(data) > SLICE:
            yield from _sets(batch, k)
            batch, size = [], 0
        batch.append(data)
        size += len(data) + 1
    yield from _sets(batch, k)


def _long_words(text: bytes) -> np.ndarray:
    """Hashes of one text's words, part by part where it is long; parts end at white space."""
    parts, start = [], 0
    while len(text) - start > SLICE:
        place = _BLANK.search(text, start + SLICE)
        end = place.start() if place else len(text)
        parts.append(word_hashes([text[start:end]])[0])
        start = end
    parts.append(word_hashes([text[start:]])[0])
    return np.concatenate(parts)


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    words, owner = (_long_words(texts[0]), None) if len(texts) == 1 else word_hashes(texts)
    owner = np.zeros(len(words), np.int64) if owner is None else owner
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    weights = _mix(np.arange(1, k + 1, dtype=np.uint64) * _MULTIPLIER) | np.uint64(1)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += _mix(words[j : j + n] ^ weights[j])  * weights[j]
    rolled = _mix(rolled)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            few = words[lo:hi]
            yield _mix(
                np.array(
                    [np.sum(_mix(few ^ weights[: len(few)]) * weights[: len(few)]) + np.uint64(len(few))], np.uint64
                )
            )
        else:
            yield np.zeros(0, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The densified sketch of each set that is not empty, one row each."""
    out = np.zeros((len(sets), BINS), np.uint64)
    there = np.zeros((len(sets), BINS), bool)
    for k, values in enumerate(sets):
        bins = (values >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        out[k, bins[first]] = values[first]
        there[k, bins[first]] = True
    row, col = np.nonzero(~there)
    attempts = _tables()[2]
    turn = np.zeros(1, np.uint64)
    while len(row):
        turn += np.uint64(1)
        source = (_mix(attempts[col] + turn * _MULTIPLIER) >> np.uint64(40)).astype(np.int64) % BINS
        hit = there[row, source]
        out[row[hit], col[hit]] = out[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return out


def bin_counts(values: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each range, in the least width that holds them all."""
    counts = np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=BINS)
    return counts.astype(next(w for w in ("<u1", "<u2", "<u4") if counts.max() <= np.iinfo(w).max)).tobytes()


def _counts_of(data: list[bytes]) -> np.ndarray:
    """The numbers of :func:`bin_counts`, a row each."""
    return np.stack([np.frombuffer(b, f"<u{len(b) // BINS}").astype(np.int32) for b in data])


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch[:, : BANDS * BAND].reshape(len(sketch), BANDS, BAND)
    weights = _mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * _MULTIPLIER).reshape(BANDS, BAND) | np.uint64(1)
    return _mix(
        (_mix(parts ^ weights) * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    ).view(np.int64)


_SKETCH = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, counts binary"


def _sketch_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids, keyed, texts = (batch.column(c).slice(lo, 512) for c in range(3))
                texts = texts.to_pylist()
                sets = list(shingle_sets(texts, k))
                some = [j for j, s in enumerate(sets) if len(s)]
                sketch = sketches([sets[j] for j in some])
                keys: list = [None] * len(sets)
                counts: list = [None] * len(sets)
                for j, row in zip(some, band_keys(sketch), strict=True):
                    keys[j], counts[j] = row, bin_counts(sets[j])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        keyed,
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(
                            [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                            pa.binary(),
                        ),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(counts, pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "bands", "counts"],
                )

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                nodes, keys, texts = (batch.column(c).slice(lo, 512).to_pylist() for c in range(3))
                held = [
                    (n, s)
                    for n, key, s in zip(nodes, keys, shingle_sets(texts, k), strict=True)
                    if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n for n, _ in held], pa.int64()),
                        pa.array([s.view(np.int64) for _, s in held], pa.list_(pa.int64())),
                    ],
                    names=["node", "shingles"],
                )

    return run


def _pick(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Inner join with ``keys``, a written table: broadcast if it is small, else shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on)


def confirmed(edges: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs of ``edges`` (u, v; written) whose full sets are similar enough.

    Only the texts of nodes that occur in a pair are read into sets, one a node.
    """
    sets = _sets_of(edges.select(F.explode(F.array("u", "v")).alias("node")), nodes, docs, k, scratch)
    one = edges.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return two.select(
        "u", "v", common.alias("c"), (F.size("a") + F.size("b") - common).alias("all")
    ).filter(F.col("c") * 100 >= F.col("all") * percent).select("u", "v")


def _meet(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of different components, of two blocks of a bucket, that may be links.

        A pair that shares several buckets is looked at in the first of them alone; were
        that one not among those that go on, its centre would have settled the pair.
        """
        key = group.iloc[0]
        inner = (key["low"], key["i"]) == (key["high"], key["j"])
        left = group[(group["class"] == key["low"]) & (group["own"] == key["i"])]
        right = left if inner else group[(group["class"] == key["high"]) & (group["own"] == key["j"])]
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []})
        band = int(key["band"])
        counts, bands = _counts_of(right["counts"].tolist()), np.array(right["bands"].tolist())
        nodes, components_, sizes = (right[c].to_numpy() for c in ("node", "component", "n_shingles"))
        us, vs = [], []
        rows = zip(*(left[c] for c in ("counts", "bands", "node", "component", "n_shingles")), strict=True)
        for k, (own_counts, own_bands, node, component, n) in enumerate(rows):
            maybe = np.flatnonzero(
                (components_ != component) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
            )
            maybe = maybe[maybe > k] if inner else maybe
            if not len(maybe):
                continue
            maybe = maybe[(bands[maybe] == own_bands).argmax(axis=1) == band]
            most = np.minimum(counts[maybe], _counts_of([own_counts])).sum(axis=1)
            # As 100 * common >= percent * (both sizes - common) must hold.
            maybe = maybe[(100 + percent) * most >= percent * (n + sizes[maybe])]
            us.append(np.minimum(node, nodes[maybe]))
            vs.append(np.maximum(node, nodes[maybe]))
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"u": np.concatenate(us or none), "v": np.concatenate(vs or none)})

    return run


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """node and shingles of the wanted nodes; only their texts are read into sets, one a node.

    A node's text is found by an id and the text's hash together, so that rows without an id,
    or with one that others have, meet no more rows than have their own text.
    """
    keyed = scratch.keep(wanted.distinct().join(nodes.select("node", "first.*", "set_key"), "node"), "wanted")
    rows = docs.select(F.col("doc_id").alias("id"), "text", "text_key")
    same = rows["id"].eqNullSafe(keyed["doc_id"]) & (rows["text_key"] == keyed["text_key"])
    texts = _pick(rows, keyed, same).select("node", "set_key", "text")
    return scratch.keep(
        texts.mapInArrow(trimmed(_set_rows(k)), "node long, shingles array<long>").dropDuplicates(["node"]), "sets"
    )


def dealt_in_blocks(going: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """A row for each node of ``going`` and pair of blocks in which it meets others of its bucket.

    Sets that can be similar enough differ in size by a factor of at most 100 / ``percent``,
    so a node meets its own size class and the two beside it.
    """
    base = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    placed = going.withColumn("class", F.floor(F.log(F.col("n_shingles").cast("double")) / base))
    n = F.count(F.lit(1))
    size = F.least(F.greatest(n / SPREAD, F.lit(float(BLOCK))), F.lit(float(MOST_BLOCK)))
    blocks = placed.groupBy("bucket", "class").agg(F.ceil(n / size).cast("int").alias("blocks"))
    blocks = blocks.groupBy("bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("class", "blocks"))).alias("blocks")  # a few classes a bucket
    )
    # Written, so that both sides of the join have an exchange of their own and a hot bucket can be split.
    blocks = scratch.keep(blocks, "blocks")
    of = lambda k: F.coalesce(F.try_element_at("blocks", k), F.lit(0))
    dealt = placed.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), of(F.col("class"))).cast("int"))
    numbers = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    own, beside = F.col("own"), lambda d: F.col("class") + F.lit(d)
    pair = lambda low, i, high, j: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"))
    pairs = F.concat(
        F.transform(
            numbers(of(beside(0))), lambda k: pair(F.col("class"), F.least(own, k), F.col("class"), F.greatest(own, k))
        ),
        F.transform(numbers(of(beside(1))), lambda k: pair(F.col("class"), own, beside(1), k)),
        F.transform(numbers(of(beside(-1))), lambda k: pair(beside(-1), k, F.col("class"), own)),
    )
    return dealt.withColumn("pair", F.explode(pairs)).select(
        "bucket", "band", "pair.*", "class", "own", "node", "component", "n_shingles", "counts", "bands"
    )


def _further_links(
    members: DataFrame, found: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch
) -> DataFrame:
    """Links in the buckets (bucket, band, node) whose nodes lie in several components still."""
    placed = members.join(found, "node", "left").select(
        "bucket", "band", "node", F.coalesce("component", "node").alias("component")
    )
    several = placed.groupBy("bucket").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n")
    ).filter("least <> most and n > 2")
    several = scratch.keep(several.select("bucket"), "several")
    going = scratch.keep(placed.join(several, "bucket"), "going")
    held = nodes.select("node", "counts", "bands", "n_shingles")
    going = scratch.keep(going.join(held, "node"), "held")
    # Dealt by the pair of blocks: by the bucket alone, as the join before leaves them, a hot one would be one task.
    key = ["bucket", "low", "i", "high", "j"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt_in_blocks(going, percent, scratch).repartition(parts, *key).groupBy(*key).applyInPandas(
        _meet(percent), "u long, v long"
    )
    return confirmed(scratch.keep(met.distinct(), "maybe"), nodes, docs, words, percent, scratch)


def near_duplicates(
    docs: DataFrame, words: int = 4, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each document: n_shingles, component_id and kept.

    Words are what stands between white space, A-Z lower-cased; a document's set holds
    its distinct shingles of ``words`` words, or its whole sequence if that is shorter.
    Two documents are linked if their sets' intersection is at least ``percent`` percent
    of their union.  component_id is the smallest id that links reach.  A text without
    words, and a null one, has an empty set and stays alone.  Rows that repeat an id are
    all kept if it is their component's; a null id takes part, and a component of null
    ids alone has a null id and is kept.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows = small_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketched = scratch.keep(rows.mapInArrow(trimmed(_sketch_rows(words)), _SKETCH), "sketches")
    first = sketched.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"),
        F.min(F.struct("doc_id", "text_key")).alias("first"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
        F.first("counts").alias("counts"),
    )
    nodes = scratch.keep(first.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    centres = scratch.keep(
        buckets.groupBy("bucket").agg(
            F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")
        ).filter("n > 1").select("bucket", "centre"),
        "centres",
    )
    members = scratch.keep(buckets.join(centres, "bucket").select("bucket", "band", "node", "centre"), "members")
    edges = scratch.keep(
        members.filter("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct(),
        "edges",
    )
    links = scratch.keep(confirmed(edges, nodes, rows, words, percent, scratch), "links")
    found = components(links, scratch)
    scratch.drop_all_but("sketches", "nodes", "members", "links", "found")
    more = scratch.keep(_further_links(members, found, nodes, rows, words, percent, scratch), "more")
    if more.head(1):
        # What is connected already comes in as stars.
        stars = found.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = components(stars.union(more), scratch)
    named = nodes.select("node", "set_key", "doc_id").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = scratch.keep(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    by_set = scratch.keep(named.join(least, "component").select("set_key", "component_id"), "by-set")
    scratch.drop_all_but("sketches", "by-set")
    out = sketched.select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One document of each component of :func:`near_duplicates`, with all its columns.

    Documents are told apart by a key that is written with them, so ids may be null or
    occur on several rows: of each component the least id stays, a null one last, and one
    row of it.  Texts without words all stay.
    """
    row, gone = unused_names(docs, "row_key", "gone_key")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "near-keyed")
    placed = near_duplicates(keyed, words, percent, row, text_column).select(F.col("doc_id").alias(row), "component_id")
    placed = materialise(placed, "near-placed")
    rank = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col(row).alias("c"))
    stay = placed.join(keyed.select(row, F.col(id_column).alias("id")), row).groupBy("component_id").agg(
        F.min(rank).alias("least")
    ).select(F.col("least.c").alias(row))
    dropped = materialise(placed.join(stay, row, "left_anti").select(F.col(row).alias(gone)), "near-dropped")
    return keyed.join(
        F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, keyed[row] == F.col(gone), "left_anti"
    ).drop(row)
