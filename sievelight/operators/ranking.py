"""Ranking, caps and samples; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.hashing import seeded


def best_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group by ``order``, by a partial aggregate instead of a sort."""
    others = [c for c in df.columns if c not in keys]
    by = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), by).alias("r")).select(*keys, "r.*")


def head_per_group(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, ranked from 1.  The limit is pushed below the shuffle by Spark."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def top_distinct(df: DataFrame, group: str, text: str, n: int, clicks: str, key: str) -> DataFrame:
    """The ``n`` most clicked distinct texts of each group."""
    once = df.groupBy(group, text).agg(
        F.max(clicks).alias(clicks),
        F.min_by(key, F.struct((-F.col(clicks)).alias("a"), F.col(key).alias("b"))).alias(key),
    )
    return head_per_group(once, [group], n, F.desc(clicks), F.asc(key))


def joined_top(df: DataFrame, group: str, text: str, n: int, separator: str, *order: Column) -> DataFrame:
    """The first ``n`` texts of each group, joined in order."""
    top = head_per_group(df, [group], n, *order)
    held = F.array_sort(F.collect_list(F.struct("rank", text)))
    return top.groupBy(group).agg(F.array_join(F.transform(held, lambda s: s[text]), separator).alias("top_text"))


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows in an order that the seed fixes."""
    return df.orderBy(seeded(seed, F.col(key)), F.col(key)).limit(n)


def stratified_sample(df: DataFrame, strata: list[str], n: int, seed: int, key: str) -> DataFrame:
    """Up to ``n`` rows of each stratum."""
    return head_per_group(df, strata, n, seeded(seed, F.col(key)), F.col(key))


def top_up(df: DataFrame, strata: list[str], per_stratum: int, total: int, seed: int, key: str) -> DataFrame:
    """Up to ``per_stratum`` rows of each stratum, then rows of any until there are ``total``; none twice."""
    order = seeded(seed, F.col(key))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key)))
    return ranked.orderBy((F.col("_r") > per_stratum).cast("int"), order, key).limit(total).drop("_r")


def diversity_first(df: DataFrame, cluster: str, n: int, key: str, *order: Column) -> DataFrame:
    """``n`` rows: the first of every cluster before the second of any."""
    ranked = df.withColumn("cluster_rank", F.row_number().over(Window.partitionBy(cluster).orderBy(*order)))
    return ranked.orderBy((F.col("cluster_rank") > 1).cast("int"), *order, F.col(key)).limit(n)


def mandatory_then_random(df: DataFrame, rare: Column, n: int, seed: int, key: str) -> DataFrame:
    """The table with in_core: all rare rows and as many others, in seeded order, as make up ``n``."""
    h = seeded(seed, F.col(key))
    core = df.select(key, (~rare).cast("int").alias("_common"), h.alias("_h")).orderBy("_common", "_h", key)
    rare_n = df.filter(rare).count()
    if rare_n >= n:
        return df.withColumn("in_core", F.coalesce(rare, F.lit(False)))
    chosen = core.limit(n).select(key).withColumn("in_core", F.lit(True))
    return df.join(chosen, key, "left").withColumn("in_core", F.coalesce("in_core", F.lit(False)))


def numbered(df: DataFrame, group: str, *order: Column, out: str = "id") -> DataFrame:
    """Ids such as group_0001 in the order within each group."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn(out, F.format_string("%s_%04d", F.col(group), k))


def lowest_to_reserve(df: DataFrame, n: int, key: str, *order: Column) -> DataFrame:
    """The table with bucket: reserve for the first ``n`` rows of the order, core for the rest.  ``key`` is unique."""
    reserve = df.orderBy(*order, F.col(key)).limit(n).select(key, F.lit("reserve").alias("bucket"))
    return df.join(reserve, key, "left").withColumn("bucket", F.coalesce("bucket", F.lit("core")))
