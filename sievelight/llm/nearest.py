"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own; a pair of centroids is a cell.  For a
query, pairs are traversed in the order of their summed distances with a heap until the
visited cells hold a budget of entries, and these are reranked by the exact cosine in
double precision.

The budget is measured, not set: a bounded set of queries is compared with all vectors,
and the budget is what the traversal needs to meet ``TARGET`` of their true neighbours.
It is a share of the table that falls as far as the vectors' structure, and centroids that
grow in number with the table, let it.

Cells whose first centroids are neighbours in number form a zone of about
``BLOCK_ENTRIES`` entries.  Entries and queries of a zone meet in bounded blocks: a zone
with more entries is dealt out over several tasks, one with many queries likewise.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.common import hash_bound, materialise

#: Vectors at most on which the centroids are fitted.
SAMPLE = 20_000
#: Centroids of a half: the root of the number of vectors, within these bounds.
FEWEST, MOST = 16, 160
ROUNDS = 12
#: Queries at most from which the budget is measured, and the part of their true neighbours that it is to meet.
CALIBRATION = 256
TARGET = 0.95
#: Entries that a query looks at, at least.
LEAST = 200
#: Entries and queries at most, on average, that meet in a task's group, and the queries looked at together.
BLOCK_ENTRIES = 8192
BLOCK_QUERIES = 4096
SLICE = 256
#: Below this part of a block's entries a query's cells are looked up one by one.
SPARSE = 0.05


@dataclass
class Codebooks:
    """Centroids of the first and the second half of unit vectors."""

    first: np.ndarray
    second: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return nearest_centroid(x[:, :half], self.first) * len(self.second) + nearest_centroid(x[:, half:], self.second)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None, :]


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(x, centroids).argmin(axis=1) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        at = nearest_centroid(distinct, centres)
        for c in range(k):
            if (own := at == c).any():
                centres[c] = distinct[own].mean(axis=0)
    return centres


def traverse(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, wanted: float) -> list[int]:
    """Cells by rising sum of distances, until they hold ``wanted`` entries; empty ones are passed over.

    The heap holds the next cell of each first centroid that has come up: its cells follow
    one another by the distance of the second, and the next first centroid comes up once
    no cell before it can be nearer.
    """
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    least, second = one[a] + two[b[0]], two[b]
    sizes = sizes.reshape(len(one), len(two))[:, b]
    heap, rows, held, cells, k = [], {}, 0, [], 0
    while held < wanted:
        while k < len(a) and (not heap or least[k] <= heap[0][0]):
            own = np.flatnonzero(sizes[a[k]])
            if len(own):
                sums = (one[a[k]] + second[own]).tolist()
                rows[k] = sums, (a[k] * len(two) + b[own]).tolist(), sizes[a[k], own].tolist()
                heapq.heappush(heap, (sums[0], k, 0))
            k += 1
        if not heap:
            break
        _, row, j = heap[0]
        sums, names, counts = rows[row]
        cells.append(names[j])
        held += counts[j]
        if j + 1 < len(sums):
            heapq.heapreplace(heap, (sums[j + 1], row, j + 1))
        else:
            heapq.heappop(heap)
    return cells


def vectors_of(column: pa.ListArray) -> np.ndarray:
    """An Arrow column of vectors of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def matrix(vectors, kind=np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, kind) for v in vectors]) if len(vectors) else np.zeros((0, 0), kind)


def level(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between 1/2 and 1, so that squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    x = level(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v of the rows that take part: no null, zero or non-finite vectors, and of the length that most rows have."""
    v = F.col(vector_column)
    if vectors.select(v).dtypes[0][1] != "array<float>":  # floats are as exact as they come, and half as wide
        v = v.cast("array<double>")
    rows = vectors.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.filter(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    lengths = good.groupBy(F.size("v").alias("length")).count().orderBy(
        F.desc("count"), F.desc("length")
    ).limit(1).collect()
    return good.filter(F.size("v") == (lengths[0]["length"] if lengths else 0))


def fit(rows: DataFrame, n: int) -> Codebooks:
    """Centroids from at most about ``SAMPLE`` rows, chosen by a hash of their ids."""
    k = min(MOST, max(FEWEST, math.isqrt(n)))
    sample = rows.filter(
        F.xxhash64("id", F.lit(11)) <= hash_bound(SAMPLE / max(1, n))
    ).select("v").limit(2 * SAMPLE).toPandas()
    x = unit(matrix(sample["v"].tolist()))
    half = x.shape[1] // 2
    return Codebooks(k_means(x[:, :half], k), k_means(x[:, half:], k))


_BEST = "query_id long, vec_id long, score double"


def _best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest scores, with all that come close to the last of them."""
    take = min(scores.shape[1], k)
    floor = -np.partition(-scores, take - 1, axis=1)[:, take - 1] - 1e-9
    return np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))


def _top(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id", sort=False).head(k)


def _near_queries(ids: np.ndarray, asked: np.ndarray, k: int):
    """The nearest of all vectors to a few queries, with their cells, by comparing them with every row."""
    directions = unit(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            scores = directions @ unit(vectors_of(batch.column(1))).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            row, col = _best_of(scores, k)
            found = pd.DataFrame(
                {"query_id": ids[row], "vec_id": own[col], "cell": cells[col], "score": scores[row, col]}
            )
            best = _top(found if best is None else pd.concat([best, found]), k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return run


def measured_budget(coded: DataFrame, queries, books: Codebooks, sizes: np.ndarray, k: int) -> float:
    """How many entries must be visited to meet ``TARGET`` of the true neighbours of some queries."""
    some = coded.filter(queries).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(CALIBRATION).collect()
    if not some:
        return LEAST
    ids, asked = np.array([r["id"] for r in some], np.int64), matrix([r["v"] for r in some])
    true = coded.mapInArrow(
        _near_queries(ids, asked, k), "query_id long, vec_id long, cell long, score double"
    ).withColumn("rank", _rank()).filter(F.col("rank") <= k).collect()
    half, at = books.first.shape[1], {q: i for i, q in enumerate(ids.tolist())}
    x = unit(asked)
    one, two = distances(x[:, :half], books.first), distances(x[:, half:], books.second)
    needed = []
    for r in true:
        order = (one[at[r["query_id"]]][:, None] + two[at[r["query_id"]]][None, :]).reshape(-1)
        needed.append(sizes[order <= order[r["cell"]]].sum())
    return max(LEAST, float(np.quantile(needed, TARGET, method="higher"))) if needed else LEAST


def _rank():
    """A window that Spark cuts to the best few before it shuffles, too."""
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))


def _meet(k: int, second: int):
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The ``k`` best entries of the block for each query, among the cells that it visits."""
        if not len(entries) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        entries = entries.sort_values("id")
        # Of equal vectors only the first ids can be among the best; one more, as a query leaves out itself.
        raw = matrix(entries["v"].tolist())
        _, same = np.unique(raw, axis=0, return_inverse=True)
        keep = pd.Series(same.reshape(-1)).groupby(same.reshape(-1)).cumcount().to_numpy() <= k
        raw, ids = raw[keep], entries["id"].to_numpy()[keep]
        raw = level(raw)
        x, sizes = unit(raw), np.linalg.norm(raw, axis=1)
        cells = entries["cell"].to_numpy()[keep] - int(entries["start"].iloc[0]) * second
        there, place = np.unique(cells, return_inverse=True)
        members = [np.flatnonzero(place == c) for c in range(len(there))]
        out = []
        for lo in range(0, len(queries), SLICE):
            part = queries.iloc[lo : lo + SLICE]
            asked, own = level(matrix(part["v"].tolist())), part["id"].to_numpy()
            directions = unit(asked)
            bits = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in part["cells"]]), axis=1)[:, there] > 0
            if bits[:, place].mean() < SPARSE:
                near = np.full((len(asked), len(ids)), -np.inf)
                for c in np.flatnonzero(bits.any(axis=0)):
                    rows = np.flatnonzero(bits[:, c])
                    near[np.ix_(rows, members[c])] = directions[rows] @ x[members[c]].T
            else:
                near = np.where(bits[:, place], directions @ x.T, -np.inf)
            near[own[:, None] == ids[None, :]] = -np.inf
            row, col = _best_of(near, k)
            score = np.einsum("ij,ij->i", asked[row], raw[col]) / (np.linalg.norm(asked, axis=1)[row] * sizes[col])
            out.append(_top(pd.DataFrame({"query_id": own[row], "vec_id": ids[col], "score": score}), k))
        return pd.concat(out)

    return run


def _visits(books: Codebooks, sizes: np.ndarray, starts: np.ndarray, wanted: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query the zones that it visits and its cells there, a bit for each cell of the zone."""
        second = len(books.second)
        ends = np.r_[starts[1:], len(books.first)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(vectors_of(batch.column(1)))
            half = books.first.shape[1]
            one, two = distances(x[:, :half], books.first), distances(x[:, half:], books.second)
            visits = []
            for a, b in zip(one, two, strict=True):
                visited = np.zeros(len(sizes), bool)
                visited[traverse(a, b, sizes, wanted)] = True
                visited = visited.reshape(len(books.first), second)
                zones = [visited[lo:hi].reshape(-1) for lo, hi in zip(starts, ends, strict=True)]
                visits.append([{"zone": z, "cells": np.packbits(v).tobytes()} for z, v in enumerate(zones) if v.any()])
            kind = pa.list_(pa.struct([("zone", pa.int32()), ("cells", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, kind)], names=["id", "v", "visits"])

    return run


def search(
    vectors: DataFrame,
    queries,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    share: float | None = None,
) -> DataFrame:
    """The ``k`` nearest entries found for each query: query_id, rank, vec_id, score.

    ``queries`` is a condition on the id column named "id".  Nearness is the cosine, in
    double precision; ties go to the smaller id.  A query visits cells with at least
    ``share`` of all vectors, or with the budget that :func:`measured_budget` gives.  Rows
    that repeat an id and a vector count once each as entries, and a query is never its own
    entry.  Vectors that are null or zero or hold null or non-finite components take no
    part, nor do null ids and vectors of another length than most have.  Very small and very
    large vectors are levelled by powers of two, which leaves the cosine as it is.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    kind = dict(rows.dtypes)["v"]
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(rows, n)
    shared = spark.sparkContext.broadcast(books)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = pa.array(shared.value.assign(unit(vectors_of(batch.column(1)))), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=["id", "v", "cell"])

    coded = materialise(rows.mapInArrow(quantise, f"id long, v {kind}, cell long"), "imi-entries")
    second = len(books.second)
    sizes = np.zeros(len(books.first) * second, np.int64)
    for cell, size in coded.groupBy("cell").count().collect():  # a row for each pair of centroids at most
        sizes[cell] = size
    wanted = measured_budget(coded, queries, books, sizes, k) if share is None else max(LEAST, share * n)
    # Zones of first centroids; the arrays below have an element for each of at most MOST of them.
    of_first = sizes.reshape(-1, second).sum(axis=1)
    before = np.cumsum(of_first) - of_first
    zone = np.unique(before // BLOCK_ENTRIES, return_inverse=True)[1].reshape(-1)
    starts = np.flatnonzero(np.r_[True, zone[1:] != zone[:-1]])
    parts = np.maximum(1, -(-np.add.reduceat(of_first, starts) // BLOCK_ENTRIES))
    visits = materialise(
        coded.filter(queries).select("id", "v").mapInArrow(
            _visits(books, sizes, starts, wanted), f"id long, v {kind}, visits array<struct<zone:int,cells:binary>>"
        ),
        "imi-visits",
    ).select("id", "v", F.inline("visits"))
    crowd = np.ones(len(parts), np.int64)
    for z, size in visits.groupBy("zone").count().collect():
        crowd[z] = -(-size // BLOCK_QUERIES)
    of = lambda values, at: F.get(F.lit([int(x) for x in values]), at)
    at = F.col("zone")
    entries = coded.withColumn("zone", of(zone, F.expr(f"cast(cell div {second} as int)")))
    entries = entries.withColumns({"start": of(starts, at), "part": F.pmod(F.xxhash64("id"), of(parts, at)).cast("int")})
    entries = entries.withColumn("crowd", F.explode(F.sequence(F.lit(0), of(crowd, at) - 1)))
    visits = visits.withColumn("crowd", F.pmod(F.xxhash64("id", F.lit(3)), of(crowd, at)).cast("int"))
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), of(parts, at) - 1)))
    key = ["zone", "part", "crowd"]
    best = entries.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(_meet(k, second), _BEST)
    ranked = best.withColumn("rank", _rank()).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
