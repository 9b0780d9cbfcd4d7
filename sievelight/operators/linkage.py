"""Average linkage of cluster centroids, never across categories.

The average cosine distance of two groups is 1 less the product of their mean vectors, so a group is
known by its mean and size.  Pairs of groups that are each other's nearest merge, all of them in a
round, in which groups meet block by block; what fits a block is merged to the end in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import vectors as vx
from sievelight.operators.graph import components
from sievelight.operators.neighbours import matrix
from sievelight.sources.storage import Scratch

#: Groups of a category whose distances one task holds.
BLOCK = 2048


def upgma(vectors: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """Average linkage on cosine distances: merges (a, b, height, size) by rising height.

    Clusters are numbered as in a dendrogram: the points first, then the merges.  A chain
    of nearest neighbours finds each merge in time that is quadratic in all.  With ``sizes``,
    rows are mean unit vectors of groups of so many points, taken as they are.
    """
    n = len(vectors)
    u = vectors if sizes is not None else vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n) if sizes is None else np.array(sizes, float), np.ones(n, bool)
    points = size.copy()
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        at = chain[-1]
        row = np.where(alive, d[at], np.inf)
        near = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[near]:
            near = chain[-2]
            chain = chain[:-2]
            a, b = sorted((at, near))
            merges.append((a, b, float(d[at, near])))
            mixed = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a], d[:, a] = mixed, mixed
            d[a, a] = np.inf
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(near)
    merges.sort(key=lambda m: m[2])
    name, parent, count, out = list(range(n)), list(range(n)), [int(x) for x in points], []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, (a, b, h) in enumerate(merges):
        a, b = root(a), root(b)
        parent[b] = a
        count[a] += count[b]
        out.append((*sorted((name[a], name[b])), h, count[a]))
        name[a] = n + k
    return out


def cut_tree(n: int, merges: list[tuple[int, int, float, int]], height: float) -> list[int]:
    """A label for each point: merges up to ``height`` hold; labels follow the first members."""
    group = [{k} for k in range(n)]
    for a, b, h, _ in merges:
        group.append(group[a] | group[b] if h <= height else set())
    label = [-1] * n
    tops = sorted((g for g in group if g), key=len)
    for g in tops:
        for k in g:
            label[k] = min(g)
    order = {v: k for k, v in enumerate(sorted(set(label)))}
    return [order[v] for v in label]


def _nearest(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """For each group of two blocks the nearest in the other, the least id of equal ones."""
    *_, low, high = key
    group = group.sort_values("id")
    a, b = group[group["own"] == low], group[group["own"] == high]
    found = []
    if len(a) and len(b):
        d = 1 - matrix(a["m"]) @ matrix(b["m"]).T
        if low == high:
            d = (d + d.T) / 2  # the same from both ends
            np.fill_diagonal(d, np.inf)
        for one, two, far in ((a, b, d), (b, a, d.T))[: 1 if low == high else 2]:
            at = far.argmin(axis=1)
            found.append(pd.DataFrame({
                "c": one["c"].to_numpy(), "id": one["id"].to_numpy(), "d": far[np.arange(len(at)), at], "other": two["id"].to_numpy()[at]
            }))
    out = pd.concat(found) if found else pd.DataFrame({"c": [], "id": [], "d": [], "other": []})
    return out[np.isfinite(out["d"].astype(float))]


def linkage(
    centres: DataFrame, category: str, cluster: str = "cluster_id", vector: str = "centroid", block: int = BLOCK
) -> DataFrame:
    """category, a, b, height and size of all merges: the least clusters of the two groups that merge, and how many clusters both have.

    Cluster ids are distinct integers.  Rows without a vector merge with nothing.
    """
    scratch = Scratch(centres.sparkSession, "linkage")
    kind = centres.schema[category].dataType.simpleString()
    state = centres.select(
        F.col(category).alias("c"), F.col(cluster).cast("long").alias("id"), vx.unit(vx.doubles(F.col(vector))).alias("m"), F.lit(1).cast("long").alias("n")
    )
    state = scratch.keep(state.filter("m is not null"), "state.0")
    merges, k = None, 0
    while True:
        counts = state.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1")
        counts = scratch.keep(counts, f"counts.{k}")
        if not counts.head(1):
            break
        k += 1
        held = state.join(counts, state["c"].eqNullSafe(counts["c"])).drop(counts["c"])
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        dealt = held.select("c", "id", "m", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("c", "id", "m", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        met = dealt.groupBy("c", "low", "high").applyInPandas(_nearest, f"c {kind}, id long, d double, other long")
        near = scratch.keep(met.groupBy("id").agg(F.min(F.struct("d", "other")).alias("near")).select("id", "near.*"), f"near.{k}")
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id2"))
        pairs = scratch.keep(near.join(back, "other").filter("id = id2 and id < other").select("id", "other", "d"), f"pairs.{k}")
        one = state.join(pairs, "id")
        two = state.select(F.col("id").alias("other"), F.col("m").alias("m2"), F.col("n").alias("n2"))
        mixed = F.zip_with("m", "m2", lambda x, y: (F.col("n") * x + F.col("n2") * y) / (F.col("n") + F.col("n2")))
        both = scratch.keep(one.join(two, "other").select("c", "id", "other", "d", mixed.alias("m"), (F.col("n") + F.col("n2")).alias("n")), f"both.{k}")
        gone = both.select("id").union(both.select("other"))
        state = scratch.keep(state.join(gone, "id", "left_anti").unionByName(both.select("c", "id", "m", "n")), f"state.{k}")
        new = both.select("c", F.col("id").alias("a"), F.col("other").alias("b"), F.col("d").alias("height"), F.col("n").alias("size"))
        merges = scratch.keep(new if merges is None else merges.union(new), f"merges.{k}")
        scratch.drop_all_but(f"state.{k}", f"merges.{k}")

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, rows = group["id"].tolist(), []
        for a, b, h, size in upgma(matrix(group["m"]), group["n"].to_numpy()):
            rows.append((group["c"].iloc[0], *sorted((ids[a], ids[b])), h, size))
            ids.append(min(ids[a], ids[b]))
        return pd.DataFrame(rows, columns=["c", "a", "b", "height", "size"])

    schema = f"c {kind}, a long, b long, height double, size long"
    last = state.groupBy("c").applyInPandas(finish, schema)
    done = scratch.keep(last if merges is None else merges.union(last), "done")
    scratch.drop_all_but("done")
    return done.withColumnRenamed("c", category)


def groups_up_to(centres: DataFrame, merges: DataFrame, category: str, height, cluster: str = "cluster_id") -> DataFrame:
    """category, cluster and merged, the number of its group in the category by least member, when merges up to ``height`` hold.

    ``height`` is a number or a column of ``merges``.  Heights never fall, so these merges are all that led to them.
    """
    joined = components(merges.filter(F.col("height") <= height).select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = centres.select(category, cluster, F.col(cluster).cast("long").alias("node"))
    rows = rows.join(joined, "node", "left").withColumn("top", F.coalesce("component", "node"))
    tops = rows.filter(F.col("top") == F.col("node"))
    number = F.row_number().over(Window.partitionBy(category).orderBy("top")) - 1  # a row a group
    named = tops.select("top", number.alias("merged"))
    return rows.join(named, "top").select(category, cluster, "merged")


def merge_within(
    centres: DataFrame, category: str, share: float = 0.25, cluster: str = "cluster_id", vector: str = "centroid", merges: DataFrame | None = None
) -> DataFrame:
    """Clusters merged by average linkage, never across categories: category, cluster, merged and cut.

    The cut lies at ``share`` of the way from the lowest to the highest merge of the
    category.  ``merges`` are those of :func:`linkage`, if they are there already.
    """
    merges = merges if merges is not None else linkage(centres, category, cluster, vector)
    low, high = F.min("height"), F.max("height")
    cuts = merges.groupBy(category).agg((low + share * (high - low)).alias("cut"))
    at = cuts.withColumnRenamed(category, "_of")
    rated = merges.join(at, merges[category].eqNullSafe(at["_of"]))
    found = groups_up_to(centres, rated, category, F.col("cut"), cluster)
    out = found.join(at, found[category].eqNullSafe(at["_of"]), "left")
    return out.select(category, cluster, "merged", F.coalesce("cut", F.lit(0.0)).alias("cut"))


def merge_at(
    centres: DataFrame, category: str, height: float, cluster: str = "cluster_id", vector: str = "centroid", merges: DataFrame | None = None
) -> DataFrame:
    """Clusters merged by average linkage up to a height, never across categories: category, cluster, merged."""
    merges = merges if merges is not None else linkage(centres, category, cluster, vector)
    return groups_up_to(centres, merges, category, F.lit(height), cluster)


def merge_heights(
    centres: DataFrame, category: str, cluster: str = "cluster_id", vector: str = "centroid", merges: DataFrame | None = None
) -> DataFrame:
    """The heights of all merges in each category."""
    merges = merges if merges is not None else linkage(centres, category, cluster, vector)
    return merges.select(category, "height", F.col("size").cast("int").alias("size"))
