"""Set operations, resumption, patches and invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a frame without a column has nulls there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def remaining(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not done yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def excluding(df: DataFrame, excluded: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that share no value of any of the columns with ``excluded``: an anti-join for each, never one with OR."""
    for c in columns:
        df = df.join(excluded.select(c).filter(F.col(c).isNotNull()).distinct(), c, "left_anti")
    return df


def excluded_ids(*columns: tuple[DataFrame, str]) -> DataFrame:
    """All distinct ids of some columns of some tables, as id."""
    return reduce(
        lambda a, b: a.union(b), (df.select(F.col(c).alias("id")) for df, c in columns)
    ).filter("id is not null").distinct()


def patched(df: DataFrame, patches: DataFrame, key: str, column: str, reason: str = "reason") -> DataFrame:
    """The table with ``column`` replaced where a patch has the key, and the patch's reason; patching again changes nothing."""
    new = patches.select(key, F.col(column).alias("_new"), F.col(reason).alias("_why"))
    joined = df.join(new, key, "left")
    why = F.when(
        F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column)),
        F.concat(F.lit("[manual] "), F.coalesce("_why", F.lit(""))),
    )
    return joined.withColumn("patch_reason", why).withColumn(column, F.coalesce("_new", column)).drop("_new", "_why")


def swap(base: DataFrame, dropped: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """``base`` without the dropped keys, and with the added rows."""
    return union_all(base.join(dropped.select(key).distinct(), key, "left_anti"), added)


def new_texts(candidates: DataFrame, existing: DataFrame, key: str, *order) -> DataFrame:
    """Candidates whose key exists nowhere yet, one for each key."""
    from sievelight.operators.ranking import best_row

    return best_row(candidates.join(existing.select(key).distinct(), key, "left_anti"), [key], *order)


class BrokenInvariant(AssertionError):
    pass


def expect_none(violations: DataFrame, what: str) -> None:
    """Raises if ``violations`` has a row."""
    found = violations.limit(3).collect()
    if found:
        raise BrokenInvariant(f"{what}: {found}")


def expect_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    expect_none(a.select(key).intersect(b.select(key)), f"{key} in both")


def expect_one_value(df: DataFrame, key: str, value: str) -> None:
    """Each key has one value, such as each cluster one split."""
    expect_none(df.groupBy(key).agg(F.count_distinct(value).alias("n")).filter("n > 1"), f"several {value} for a {key}")


def expect_matched(left: DataFrame, right: DataFrame, key: str) -> None:
    expect_none(left.select(key).join(right.select(key), key, "left_anti"), f"{key} without a match")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
