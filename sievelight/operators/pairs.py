"""Anchors, synthetic variants and probe datasets without leaks between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.hashing import grade_of, split_of
from sievelight.functions.text import is_natural
from sievelight.operators.ranking import best_row, head_per_group
from sievelight.operators.sets import excluding

AXES = ("MU", "PU", "ET")
#: Limits of the datasets.
NEGATIVES_PER_CLUSTER = 6
NEGATIVE_RATIO = 3
PER_CLUSTER = 3


def axis_long(picks: DataFrame, keep: list[str], axes=AXES) -> DataFrame:
    """One row for each axis of each pick whose token is of that axis: keep, axis, grade_token, grade."""
    long = picks.unpivot(keep, [f"{a.lower()}_grade" for a in axes], "column", "grade_token")
    long = long.withColumn("axis", F.upper(F.substring_index("column", "_", 1))).drop("column")
    return long.filter(F.startswith("grade_token", "axis")).withColumn("grade", grade_of(F.col("grade_token")))


def axis_wide(anchors: DataFrame, key: str, axes=AXES) -> DataFrame:
    """One row for each key with the grade of every axis; the least if there are several."""
    return anchors.groupBy(key).pivot("axis", list(axes)).agg(F.min("grade"))


def anchor_pool(picks: DataFrame, golden: DataFrame) -> DataFrame:
    """Picks of no key and no cluster of the golden set, axis by axis."""
    keys = golden.select("query_key")
    clusters = golden.select("supercluster_id")
    if "synthesis_cluster_id" in golden.columns:
        clusters = clusters.union(golden.select("synthesis_cluster_id"))
    kept = excluding(excluding(picks, keys, ["query_key"]), clusters, ["supercluster_id"])
    return axis_long(kept, ["query_key", "query_text", "supercluster_id"])


def sparsity(anchors: DataFrame) -> DataFrame:
    """Distinct queries and clusters of each axis and grade."""
    return anchors.groupBy("axis", "grade").agg(
        F.count_distinct("query_key").alias("n_queries"), F.count_distinct("supercluster_id").alias("n_clusters")
    )


def spanning_clusters(anchors: DataFrame) -> DataFrame:
    """Clusters with two grades or more on an axis."""
    return anchors.groupBy("axis", "supercluster_id").agg(
        F.count_distinct("grade").alias("n_grades")
    ).filter("n_grades >= 2")


def select_mu(wide: DataFrame, most: int = 800, cap: int = PER_CLUSTER) -> DataFrame:
    """Natural queries of MU1, all of them, filled up with MU0 on ET1 topics, some of each cluster."""
    natural = wide.filter(is_natural(F.col("query_text")))
    one = natural.filter("mu = 1").withColumn("part", F.lit(0))
    zero = head_per_group(
        natural.filter("mu = 0 and et = 1"), ["supercluster_id"], cap, F.asc("query_key")
    ).drop("rank").withColumn("part", F.lit(1))
    need = max(0, most - one.count())
    return one.unionByName(zero.orderBy("query_key").limit(need))


def select_pu(wide: DataFrame, most: int = 1000, cap: int = PER_CLUSTER, heavy: float = 0.6) -> DataFrame:
    """Natural queries of PU0: a share on ET2 topics and the rest on ET1, some of each cluster."""
    natural = wide.filter("pu = 0").filter(is_natural(F.col("query_text")))
    n2 = int(most * heavy)
    part = lambda et, n: head_per_group(
        natural.filter(F.col("et") == et), ["supercluster_id"], cap, F.asc("query_key")
    ).drop("rank").orderBy("query_key").limit(n).withColumn("part", F.lit(2 - et))
    return part(2, n2).unionByName(part(1, most - n2))


def matched_negatives(
    real: DataFrame,
    positives: DataFrame,
    n_two: int,
    per_cluster: int = NEGATIVES_PER_CLUSTER,
    ratio: int = NEGATIVE_RATIO,
) -> DataFrame:
    """Grade-0 rows of the positives' clusters, some of each, at most ``ratio`` for each grade-2 positive."""
    near = real.filter("grade = 0").join(positives.select("supercluster_id").distinct(), "supercluster_id", "left_semi")
    return head_per_group(
        near, ["supercluster_id"], per_cluster, F.asc("query_key")
    ).drop("rank").orderBy("query_key").limit(ratio * n_two)


def probe_dataset(
    real: DataFrame, synthetic: DataFrame, axis: str, one_cap: int = 1000, zero_cap: int = 1000
) -> DataFrame:
    """Rows of one axis with a split by cluster: text, grade, axis, supercluster_id, source, query_key, pair_key, anchor_grade, split.

    With confirmed synthetic variants they are the positives, and negatives come from
    their clusters; without, every grade is real and capped.  Of equal texts the row of
    the highest grade and then the smallest key stays.
    """
    own = real.filter(F.col("axis") == axis)
    variant = synthetic.filter((F.col("axis") == axis) & F.col("verifier_confirmed"))
    columns = lambda df, source: df.select(
        F.col("query_text").alias("text"),
        F.col("grade").cast("int"),
        F.lit(axis).alias("axis"),
        "supercluster_id",
        F.lit(source).alias("source"),
        "query_key",
        F.col("query_key").alias("pair_key"),
        F.col("grade").cast("int").alias("anchor_grade"),
    )
    n_two = variant.filter("target_grade = 2").count()
    if not n_two:
        ranked = head_per_group(own, ["grade"], zero_cap, F.asc("query_key")).drop("rank")
        every = columns(ranked, "real")
    else:
        made = variant.select(
            "text",
            F.col("target_grade").cast("int").alias("grade"),
            F.lit(axis).alias("axis"),
            "supercluster_id",
            F.lit("synth").alias("source"),
            F.concat("anchor_query_key", F.lit(":v"), "target_grade").alias("query_key"),
            F.col("anchor_query_key").alias("pair_key"),
            F.col("anchor_grade").cast("int").alias("anchor_grade"),
        )
        ones = made.filter("grade = 1")
        one = ones.orderBy("query_key").limit(one_cap) if ones.head(1) else columns(
            own.filter("grade = 1").orderBy("query_key").limit(one_cap), "real"
        )
        every = made.filter("grade = 2").unionByName(one).unionByName(
            columns(matched_negatives(own, variant, n_two), "real")
        )
    once = best_row(every, ["text"], -F.col("grade"), F.col("query_key"))
    return once.withColumn("split", split_of(F.col("supercluster_id")))
