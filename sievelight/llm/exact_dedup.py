"""Exact deduplication by two-pass Bloom filtering.

Pass one folds every text's hash into a two-level Bloom filter ("seen" and "seen
again").  Pass two tests each hash against the second level: a text whose bits were
not all set twice is certainly unique and passes straight through; only the rest is
shuffled by its SHA-256.  A false positive costs a shuffled row and nothing else, so
the result is exact at any filter size.

The filter has 16 bits a row and at most as many as a set part of the memory of a driver
and an executor holds (:func:`most_bits`); that bound holds for what is sent to the driver
and broadcast.  With fewer bits a row each hash sets fewer of them; more rows are shuffled
then, and none is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import materialise, trimmed, unused_names, whole_text

#: The part of the smaller of both memories that a filter takes at most.
MEMORY_PART = 64
BLOCK_BITS = 1 << 16
#: Bits that a hash sets at most.
PROBES = 3
#: Groups into which the partial filters of a block are merged first.
MERGE_WAYS = 32


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(whole_text(column), r"[\x20\x09-\x0D]+", "")


def most_bits(spark: SparkSession) -> int:
    """Bits of a filter at most: a power of two, 2^27 (16 MB) with memories of 1 GB, 2^30 with 8 GB."""

    def size(key: str) -> int:
        number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.sparkContext.getConf().get(key, "1g").lower()).groups()
        return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)

    least = min(size("spark.driver.memory"), size("spark.executor.memory"))
    return max(BLOCK_BITS, 1 << ((8 * least // MEMORY_PART).bit_length() - 1))


def probes_for(bits: int, rows: int) -> int:
    """How many bits a hash sets, so that a filter with few bits a row isn't full."""
    return PROBES if bits >= 8 * rows else 2 if bits >= 4 * rows else 1


def probes(hashes: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The positions of each hash, by double hashing; one row for each of ``n`` probes."""
    h = hashes.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        first = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        second = ((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        rounds = np.arange(n, dtype=np.uint64)[:, None]
        mixed = first[None, :] + rounds * second[None, :]
    return ((mixed >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)


def pack(offsets: np.ndarray) -> bytes:
    """Offsets in a block as a sorted list or as a bitmap, whichever is shorter."""
    if 2 * len(offsets) < BLOCK_BITS // 8:
        return offsets.astype("<u2").tobytes()
    return bitmap(offsets).tobytes()


def bitmap(offsets: np.ndarray) -> np.ndarray:
    bits = np.zeros(BLOCK_BITS, np.uint8)
    bits[offsets] = 1
    return np.packbits(bits)


def unpack(data: bytes) -> np.ndarray:
    if len(data) == BLOCK_BITS // 8:
        return np.frombuffer(data, np.uint8)
    return bitmap(np.frombuffer(data, "<u2"))


def _partial_filters(bits: int, n: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, times = np.unique(probes(batch.column(0).to_numpy(zero_copy_only=False), bits, n), return_counts=True)
            blocks = at // BLOCK_BITS
            edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True])
            block, way, seen, again = [], [], [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                offsets = at[lo:hi] % BLOCK_BITS
                block.append(int(blocks[lo]))
                way.append(int(offsets[0] + len(offsets)) % MERGE_WAYS)
                seen.append(pack(offsets))
                again.append(pack(offsets[times[lo:hi] > 1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block, pa.int32()),
                    pa.array(way, pa.int32()),
                    pa.array(seen, pa.binary()),
                    pa.array(again, pa.binary()),
                ],
                names=["block", "way", "seen", "again"],
            )

    return build


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    seen = np.zeros(BLOCK_BITS // 8, np.uint8)
    again = np.zeros(BLOCK_BITS // 8, np.uint8)
    for s, a in zip(group["seen"], group["again"], strict=True):
        new = unpack(s)
        again |= unpack(a) | (seen & new)
        seen |= new
    return pd.DataFrame(
        {"block": group["block"].iloc[:1], "way": [0], "seen": [seen.tobytes()], "again": [again.tobytes()]}
    )


def repeated_filter(hashes: DataFrame, rows: int, max_bits: int | None = None) -> np.ndarray:
    """The level "seen again" over ``hashes``, a DataFrame of one long column."""
    most = most_bits(hashes.sparkSession) if max_bits is None else max_bits
    bits = BLOCK_BITS
    while bits < min(16 * rows, most):
        bits *= 2
    schema = "block int, way int, seen binary, again binary"
    parts = hashes.mapInArrow(trimmed(_partial_filters(bits, probes_for(bits, rows))), schema)
    parts = parts.groupBy("block", "way").applyInPandas(_merge, schema)
    parts = parts.groupBy("block").applyInPandas(_merge, schema)
    level = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in parts.select("block", "again").toLocalIterator():
        level[row["block"]] = np.frombuffer(row["again"], np.uint8)
    return level.reshape(-1)


def maybe_repeated(df: DataFrame, level: np.ndarray, rows: int, hash_column: str) -> Column:
    """False only for hashes that occur once."""
    bits = len(level) * 8
    n = probes_for(bits, rows)
    shared = df.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        at = probes(hashes.to_numpy(), bits, n)
        hit = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=0))

    return test(F.col(hash_column))


def _better(n: str, doc: str, row: str | None = None) -> Column:
    """The order of the rows of a group: most code points, then the smallest id, null last.

    A bitwise not turns the order of all longs round; a minus would overflow at the least one.
    """
    turned = lambda name: F.bitwise_not(F.col(name).cast("long"))
    return F.struct(F.col(n), turned(doc).alias("by_id"), *([turned(row).alias("by_row")] if row else []))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: what it equals and which row of its group stays.

    Texts are equal when identical without white space.  The row with the most code
    points stays, then that with the smallest id; a null id comes last.  Rows that
    repeat an id and a text count each and exactly one of them stays.  Null text
    counts as empty; empty texts equal each other.  An empty table gives no rows.
    Only the two named columns are read, so others may have any name.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    prints = materialise(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.length(whole_text(text_column)).alias("n"),
            F.unhex(F.sha2(normalised(text_column), 256)).alias("sha"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "exact-prints",
    ).withColumn("hash", F.xxhash64("sha"))
    rows = prints.count()
    level = repeated_filter(prints.select("hash"), rows)
    prints = prints.withColumn("maybe", maybe_repeated(prints, level, rows, "hash"))

    def result(df: DataFrame, keep: Column, size: Column, kept: Column) -> DataFrame:
        return df.select(
            "doc_id",
            keep.alias("keep_id"),
            size.alias("group_size"),
            kept.alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )

    alone = result(prints.filter(~F.col("maybe")), F.col("doc_id"), F.lit(1).cast("long"), F.lit(True))
    again = prints.filter("maybe").select("doc_id", "n", "sha", "row")
    # The groups are written so that both sides of the join have an exchange of their own and a hot group can be split.
    groups = materialise(
        again.groupBy("sha").agg(F.count(F.lit(1)).alias("size"), F.max(_better("n", "doc_id", "row")).alias("best")),
        "exact-groups",
    ).select(
        "sha", "size", F.bitwise_not("best.by_id").alias("best_id"), F.bitwise_not("best.by_row").alias("best_row")
    )
    return alone.unionByName(
        result(again.join(groups, "sha"), F.col("best_id"), F.col("size"), F.col("row") == F.col("best_row"))
    )


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that :func:`exact_duplicates` keeps, with all their columns.

    Unique documents are never shuffled; of the others one row a group is gathered by
    a partial aggregate, so a hot group costs one row a task.
    """
    sha, n, size, row, best = unused_names(docs, "sha", "n", "hash", "maybe", "best")
    keyed = docs.withColumns({sha: F.unhex(F.sha2(normalised(text_column), 256)), n: F.length(whole_text(text_column))})
    prints = materialise(keyed.select(F.xxhash64(sha).alias("hash")), "exact-hashes")
    rows = prints.count()
    level = repeated_filter(prints, rows)
    keyed = keyed.withColumn(size, F.xxhash64(sha))
    keyed = keyed.withColumn(row, maybe_repeated(keyed, level, rows, size))
    alone = keyed.filter(~F.col(row)).select(*docs.columns)
    again = keyed.filter(F.col(row)).groupBy(sha).agg(
        F.max_by(F.struct(*docs.columns), _better(n, id_column)).alias(best)
    )
    return alone.unionByName(again.select(f"{best}.*"))
