"""How filters of documents interact, in every order.

The documents that a set of filters removes are a game of the filters.  Its multilinear
extension is a polynomial whose coefficients come from the counts of failure masks alone: at
a corner it is the number that those filters remove, and the integral of a partial
derivative along the diagonal is a filter's Shapley value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import WHITE_SPACE, Scratch, whole_text

#: The filters' letters; bit k of a mask is set where a document fails filter k.
LETTERS = "ABCDE"

_BLANKS = r"[\x20\x09-\x0D]+"


def failures(docs: DataFrame) -> list:
    """Whether a whole text (column text, not null) fails the filters A to D."""
    bare = F.btrim("text", F.lit(WHITE_SPACE))
    words = F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, _BLANKS))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    return [
        n < 50,
        100 * distinct.cast("long") < 65 * n.cast("long"),
        100 * capitals.cast("long") > 5 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    ]


def failure_masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, mask, good and toxic of every row of ``docs`` (doc_id, text, source).

    A row fails E if a smaller doc_id has the same text; where null ids are concerned none is
    smaller.  Several labels of one id count as good, or toxic, if one of them says so.
    """
    own = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        whole_text().alias("text"),
    )
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(failures(own))), F.lit(0))
    read = scratch.keep(
        own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")), "read"
    )
    # Written, so that the joins have an exchange on both sides and a hot key can be split.
    copied = read.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    copied = scratch.keep(copied.filter("n > 1").select("digest", "least"), "copied")
    said = lambda column: F.max((F.col(column) == 1).cast("int")).alias(column)
    marked = scratch.keep(
        labels.filter("doc_id is not null").groupBy("doc_id").agg(said("quality"), said("toxic")), "marked"
    )
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return read.join(copied, "digest", "left").join(marked, "doc_id", "left").select(
        "part",
        (F.col("mask") + (1 << 4) * later).alias("mask"),
        F.coalesce("quality", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def removal_polynomial(counts: dict[int, int]) -> dict[int, int]:
    """Coefficients, by the set of variables as bits, of the sum of n * (1 - product of (1 - x_k) for k in mask)."""
    out: dict[int, int] = {}
    for mask, n in counts.items():
        part = mask
        while part:
            out[part] = out.get(part, 0) + (n if part.bit_count() % 2 else -n)
            part = (part - 1) & mask
    return out


def at_corner(polynomial: dict[int, int], ones: int) -> int:
    """Its value where the variables in ``ones`` are 1 and all others 0."""
    return sum(c for part, c in polynomial.items() if part & ~ones == 0)


def diagonal_integral(polynomial: dict[int, int], k: int) -> Fraction:
    """The integral from 0 to 1 of its derivative by variable ``k`` where all variables are equal."""
    return sum((Fraction(c, part.bit_count()) for part, c in polynomial.items() if part >> k & 1), Fraction(0))


def interactions(
    counts: dict[int, tuple[int, int, int]], letters: str = LETTERS
) -> Iterator[tuple[str, int, int, int, int, int, int, int, int]]:
    """Rows of all orders and steps from how many documents, good and toxic ones have each mask."""
    whole, good, toxic = (removal_polynomial({m: c[k] for m, c in counts.items()}) for k in range(3))
    total, full = sum(c[0] for c in counts.values()), (1 << len(letters)) - 1
    corners = [[at_corner(p, ones) for ones in range(full + 1)] for p in (whole, good, toxic)]
    removed, lost, spared = corners
    each = []
    for k in range(len(letters)):
        shapley = math.factorial(len(letters)) * diagonal_integral(whole, k)
        assert shapley.denominator == 1
        each.append((removed[1 << k], removed[full] - removed[full & ~(1 << k)], shapley.numerator))
    for order in permutations(range(len(letters))):
        name, before = "".join(letters[k] for k in order), 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            gone = removed[after] - removed[before]
            fails, unique, shapley = each[k]
            yield (
                name, step, total - removed[after], gone, fails - gone, unique, lost[after] - lost[before], spared[after] - spared[before], shapley
            )
            before = after


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from rows of part, mask, good and toxic.

    Documents are counted by part and mask before they are shuffled, so that no part is hot;
    a part's polynomial is formed from its counts, 2 to the number of filters at most.
    """
    counts = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")
    )
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = interactions({r["mask"]: (r["n"], r["good"], r["toxic"]) for r in rows}, letters)
                order, step, *numbers = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(order)), pa.array(order), pa.array(step, pa.int32()), *(pa.array(x, pa.int64()) for x in numbers)],
                    names=["part", "filter_order", "step", *_COUNTS],
                )

    return parts.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in _COUNTS)}")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (source; null: empty), each order of the filters A to E and step: what the step's filter does there.

    kept, removed, redundant (fail it but are removed earlier), unique_fails (fail it alone),
    good_lost, toxic_lost, and shapley: what it removes, summed over all orders.  A null
    text counts as empty: it fails A.  Repeated rows count each; of those with equal id and
    text none is earlier, so they don't fail E by one another.  Without documents there are
    no parts and no rows.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    masks = failure_masks(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"), scratch)
    return audit(masks)
