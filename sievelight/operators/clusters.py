"""Clusters of embeddings: centroids, assignment, words, constrained merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions import vectors as vx
from sievelight.operators.ranking import head_per_group
from sievelight.sources.storage import settled

NOISE = -1
#: Centroids at most that are broadcast; beyond that, rows and centroids meet in blocks by a join.
BROADCAST_CENTROIDS = 20_000
#: Numbers in all centroids up to which they are compared in the JVM.
JVM_CENTROID_VALUES = 10_000


def centroids(points: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """The mean of each cluster at length 1; noise has none."""
    means = vx.mean_vector(points.filter(F.col(cluster) != NOISE), [cluster], vector)
    return means.select(cluster, vx.unit(F.col("centroid")).alias("centroid"))


def nearest_centroid(
    points: DataFrame,
    centres: DataFrame,
    keys: list[str],
    vector: str = "embedding",
    cluster: str = "cluster_id",
    centre_vector: str = "centroid",
) -> DataFrame:
    """For each point the centroid of the largest cosine, ties to the smaller id: keys, cluster and cosine.

    Few and short centroids are compared in the JVM.  Others are multiplied as a matrix,
    which every task gets behind a check of its size; beyond that, points are dealt out
    once for each block of centroids and the best of every block is reduced.
    """
    held = centres.select(F.col(cluster).cast("long").alias("id"), vx.doubles(F.col(centre_vector)).alias("c"))
    held = settled(held.filter("c is not null"))
    size = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("c")), F.lit(0)).alias("dim")).first()
    point = points.select(*keys, vx.doubles(F.col(vector)).alias("v"))
    if size["n"] * size["dim"] <= JVM_CENTROID_VALUES:
        one = held.agg(F.collect_list(F.struct("id", "c")).alias("all"))
        best = point.crossJoin(F.broadcast(one)).select(*keys, F.array_max(_rated("all")).alias("best"))
    elif size["n"] <= BROADCAST_CENTROIDS:
        best = _by_matrix(point, held, keys)
    else:
        blocks = -(-size["n"] // BROADCAST_CENTROIDS)
        block = F.pmod(F.xxhash64("id"), F.lit(blocks))
        grouped = held.groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "c")).alias("all"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        met = point.withColumn("block", every).join(grouped, "block")
        best = met.select(*keys, F.array_max(_rated("all")).alias("best"))
        best = best.groupBy(*keys).agg(F.max("best").alias("best"))
    kind = centres.schema[cluster].dataType
    return best.select(*keys, F.col("best.id").cast(kind).alias(cluster), F.col("best.cosine").alias("cosine"))


def _rated(centroids_: str) -> Column:
    return F.transform(
        centroids_,
        lambda s: F.struct(
            vx.cosine(F.col("v"), s["c"]).alias("cosine"), (-s["id"]).alias("minus"), s["id"].alias("id")
        ),
    )


def _by_matrix(point: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """keys and best (cosine, id) by products of Arrow batches with all centroids; nearly equal cosines count as ties."""
    rows = sorted(held.collect(), key=lambda r: r["id"])  # BROADCAST_CENTROIDS at most
    ids, matrix = np.array([r["id"] for r in rows]), np.array([r["c"] for r in rows])
    lengths = np.linalg.norm(matrix, axis=1)
    usable = lengths > 0
    ids, matrix = ids[usable], (matrix[usable].T / lengths[usable])
    shared = point.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, w = shared.value
        for frame in frames:
            out = frame[keys].copy()
            best: list = [None] * len(frame)
            there = np.flatnonzero([v is not None and len(own) > 0 for v in frame["v"]])
            for lo in range(0, len(there), 256):
                part = there[lo : lo + 256]
                x = np.stack([frame["v"].iloc[k] for k in part])
                size = np.linalg.norm(x, axis=1)
                cosines = x @ w / np.where(size > 0, size, 1.0)[:, None]
                at = (cosines >= cosines.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
                for j, k in enumerate(part):
                    if size[j] > 0:
                        best[k] = {"cosine": float(cosines[j, at[j]]), "id": int(own[at[j]])}
            out["best"] = best
            yield out

    schema = point.select(*keys).schema.add(
        "best", T.StructType([T.StructField("cosine", T.DoubleType()), T.StructField("id", T.LongType())])
    )
    return point.mapInPandas(run, schema)


def reassign_noise(points: DataFrame, key: str, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """Noise at its nearest centroid; other points as they are: key, cluster, reassigned."""
    noise = points.filter(F.col(cluster) == NOISE)
    moved = nearest_centroid(
        noise, centroids(points, cluster, vector), [key], vector, cluster
    ).select(key, cluster, F.lit(True).alias("reassigned"))
    return points.filter(F.col(cluster) != NOISE).select(
        key, cluster, F.lit(False).alias("reassigned")
    ).unionByName(moved)


def exemplars(
    points: DataFrame, key: str, n: int = 10, cluster: str = "cluster_id", vector: str = "embedding"
) -> DataFrame:
    """The ``n`` members of each cluster nearest to its centroid."""
    near = points.join(centroids(points, cluster, vector), cluster).withColumn(
        "cosine", vx.cosine(vx.doubles(F.col(vector)), F.col("centroid"))
    )
    # The order is of rounded values, so that engines agree on near ties.
    return head_per_group(
        near.select(cluster, key, F.round("cosine", 6).alias("cosine")), [cluster], n, F.desc("cosine"), F.asc(key)
    )


def pairwise_distances(
    centres: DataFrame, cluster: str = "cluster_id", vector: str = "centroid", within: str | None = None
) -> DataFrame:
    """1 - cosine of all pairs of a table of centroids, optionally within a category: a_id < b_id, distance."""
    side = lambda p: centres.select(
        F.col(cluster).alias(f"{p}_id"),
        F.col(vector).alias(f"{p}_v"),
        *([F.col(within).alias(f"{p}_w")] if within else []),
    )
    cond = F.col("a_id") < F.col("b_id")
    if within:
        cond &= F.col("a_w") == F.col("b_w")
    pairs = side("a").join(side("b"), cond)
    return pairs.select(
        "a_id",
        "b_id",
        *([F.col("a_w").alias(within)] if within else []),
        (1 - vx.cosine(F.col("a_v"), F.col("b_v"))).alias("distance"),
    )


def terms(docs: DataFrame, group: str, text: str, stopwords: list[str] = (), bigrams: bool = True) -> DataFrame:
    """Counts of the words of two letters or more, and pairs of them, in each group: group, term, n."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w{2,}"), F.lit(0))
    if not bigrams:
        single = docs.select(group, F.explode(words).alias("term"))
        kept = single.filter(~F.col("term").isin(*stopwords)) if stopwords else single
        return kept.groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))
    held = docs.select(group, F.filter(words, lambda w: ~w.isin(*stopwords) if stopwords else F.lit(True)).alias("w"))
    pairs = F.when(
        F.size("w") > 1,
        F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b)),
    ).otherwise(F.array().cast("array<string>"))
    return held.select(group, F.explode(F.concat("w", pairs)).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))


def ctfidf(counts: DataFrame, group: str, n: int = 20, min_groups: int = 1) -> DataFrame:
    """The ``n`` words of each group of largest tf * log(1 + A / f).

    tf is a term's share of its group, f its count over all groups and A the mean number
    of terms in a group.
    """
    term = Window.partitionBy("term")  # as many rows as a term has groups
    kept = counts.withColumns({"f": F.sum("n").over(term), "groups": F.count(F.lit(1)).over(term)})
    kept = settled(kept.filter(F.col("groups") >= min_groups).drop("groups"))
    sizes = kept.groupBy(group).agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    rated = kept.join(sizes, group).crossJoin(F.broadcast(mean))  # one row
    weight = F.round(F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("f")), 6)
    return head_per_group(
        rated.select(group, "term", weight.alias("weight")), [group], n, F.desc("weight"), F.asc("term")
    )


def knee_table(heights: DataFrame, n_clusters: DataFrame, thresholds: list[float], height: str = "height") -> DataFrame:
    """threshold, n_merges, n_clusters and reduction (percent) at each threshold."""
    grid = heights.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    counted = grid.join(
        heights, F.col(height) <= F.col("threshold"), "left"
    ).groupBy("threshold").agg(F.count(height).alias("n_merges"))
    total = F.broadcast(n_clusters.agg(F.count(F.lit(1)).alias("total")))  # one row
    return counted.crossJoin(total).select(
        "threshold",
        "n_merges",
        (F.col("total") - F.col("n_merges")).alias("n_clusters"),
        F.round(100.0 * F.col("n_merges") / F.col("total"), 6).alias("reduction"),
    )


def _merged_groups(clusters: DataFrame, category: str, merged: str) -> DataFrame:
    groups = clusters.groupBy(category, merged).agg(
        F.sum("n_queries").alias("n_queries"),
        F.array_sort(F.collect_set("cluster_id")).alias("constituents"),
        F.min_by("label", F.struct((-F.col("n_queries")).alias("a"), F.col("cluster_id").alias("b"))).alias("label"),
        F.min("cluster_id").alias("first"),
    )
    k = F.row_number().over(Window.partitionBy(category).orderBy(F.desc("n_queries"), "first"))
    return groups.withColumn("supercluster_id", F.format_string("%s_%04d", F.col(category), k))


def _merged_members(members: DataFrame, clusters: DataFrame, category: str, merged: str) -> DataFrame:
    """Each query of each merged group once, as its most clicked row has it."""
    held = members.join(clusters.select("cluster_id", category, merged), "cluster_id")
    once = held.groupBy(category, merged, "query_key").agg(
        F.min_by(
            F.struct("query", "clicks", "cluster_id"),
            F.struct((-F.col("clicks")).alias("a"), F.col("query").alias("b"), F.col("cluster_id").alias("c")),
        ).alias("q")
    )
    return once.select(category, merged, "query_key", "q.*")


def super_clusters(
    members: DataFrame, clusters: DataFrame, category: str = "category", merged: str = "merged", limit: int = 50
) -> DataFrame:
    """A record for each merged group: id, representative, constituents, and its ``limit`` most clicked queries.

    ``clusters`` has category, merged, cluster_id, label and n_queries; ``members`` has
    cluster_id, query_key, query and clicks.  All queries are in :func:`super_cluster_queries`.
    """
    groups = _merged_groups(clusters, category, merged)
    top = head_per_group(
        _merged_members(members, clusters, category, merged),
        [category, merged],
        limit,
        F.desc("clicks"),
        F.asc("query_key"),
    )
    queries = top.groupBy(category, merged).agg(
        F.array_sort(F.collect_list(F.struct("rank", "query_key", "query", "clicks", "cluster_id"))).alias("queries")
    )
    return groups.join(queries, [category, merged], "left").drop("first")


def super_cluster_queries(
    members: DataFrame, clusters: DataFrame, category: str = "category", merged: str = "merged"
) -> DataFrame:
    """One row for each query of each merged group, all of them; takes what :func:`super_clusters` takes."""
    groups = _merged_groups(clusters, category, merged).select(category, merged, "supercluster_id", "label")
    return _merged_members(members, clusters, category, merged).join(groups, [category, merged]).select(
        "supercluster_id", "label", "query_key", "query", "clicks", "cluster_id"
    )


def exploded_super_clusters(records: DataFrame) -> DataFrame:
    """One row for each query that a record holds, its most clicked ones."""
    return records.select("supercluster_id", "label", F.explode("queries").alias("q")).select(
        "supercluster_id", "label", "q.query_key", "q.query", "q.clicks", "q.cluster_id"
    )


def merged_words(clusters: DataFrame, keys: list[str], words: str, order: str) -> DataFrame:
    """The words of all clusters of a group, the representative's first, each once."""
    held = F.array_sort(
        F.collect_list(F.struct((-F.col(order)).alias("a"), F.col("cluster_id").alias("b"), F.col(words).alias("w")))
    )
    return clusters.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(held, lambda s: s["w"]))).alias(words))


def reduce_dimensions(points: DataFrame, key: str, k: int = 5, vector: str = "embedding") -> DataFrame:
    """Principal components as a stand-in for a neighbour embedding: key, reduced."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = points.select(key, array_to_vector(vx.doubles(F.col(vector))).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(rows)
    return model.transform(rows).select(key, vector_to_array("y").alias("reduced"))


def overview(members: DataFrame, cluster: str = "cluster_id", limit: int = 20) -> DataFrame:
    """size, total clicks and the most clicked keys of each cluster, noise excepted."""
    kept = members.filter(F.col(cluster) != NOISE)
    top = head_per_group(kept, [cluster], limit, F.desc("clicks"), F.asc("query_key"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("rank", "query_key"))), lambda s: s["query_key"])
    return kept.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), F.sum("clicks").alias("total_clicks")
    ).join(top.groupBy(cluster).agg(held.alias("top_keys")), cluster)


def overview_members(members: DataFrame, cluster: str = "cluster_id", limit: int = 20) -> DataFrame:
    """A row for each member's key beside its cluster's :func:`overview`, noise excepted; no array grows with a cluster."""
    keys = members.filter(F.col(cluster) != NOISE).select(cluster, "query_key")
    return keys.join(overview(members, cluster, limit), cluster)


def size_stats(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """n_clusters, least, median and most members, and n_noise."""
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    real = F.col(cluster) != NOISE
    size = F.when(real, F.col("n"))
    return sizes.agg(
        F.count_if(real).alias("n_clusters"),
        F.min(size).alias("least"),
        F.percentile(size, F.lit(0.5)).alias("median"),
        F.max(size).alias("most"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_noise"),
    )
