"""Vectors held as arrays of doubles, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    """The vector at length 1; one shorter than ``least`` is divided by that."""
    return scale(v, 1 / F.greatest(norm(v), F.lit(least)))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine(a: Column, b: Column) -> Column:
    """The cosine; null if a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def residual(v: Column, other: Column) -> Column:
    """``v`` without its part along ``other``, at length 1."""
    return unit(minus(v, scale(other, dot(v, other) / F.greatest(dot(other, other), F.lit(1e-12)))))


def argmax(scores: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def three_class(score: Column, low: Column, high: Column) -> Column:
    return F.when(score >= high, 2).when(score >= low, 1).otherwise(0)


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """The elementwise mean of each group.

    The sums of all places are built up task by task before anything is shuffled: one
    row a place and group, whatever the group's size.
    """
    placed = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("place", "x"))
    means = placed.groupBy(*keys, "place").agg(F.avg("x").alias("x"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias(out)
    return means.groupBy(*keys).agg(held) if keys else means.agg(held)
