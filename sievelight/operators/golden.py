"""Building and measuring a golden set: quotas, sampling, agreement, backfill, packs, resolution."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.hashing import keep_fraction, source_key
from sievelight.operators.ranking import best_row

AXES = ("mu", "pu", "et")
#: Quotas of each axis, weights and fractions of categories.
TARGETS = {"MU0": 160, "MU1": 160, "MU2": 80, "PU0": 200, "PU1": 140, "PU2": 60, "ET0": 80, "ET1": 180, "ET2": 140}
CATEGORY_WEIGHT = {"oncology-core": 1.0, "oncology-adjacent": 0.7, "navigational": 0.3, "non-clinical": 0.0}
CATEGORY_FRACTION = {"oncology-core": 1.0, "oncology-adjacent": 1.0, "navigational": 0.25, "non-clinical": 0.0}
N_TOTAL, BUFFER, CLUSTER_CAP, LOW_CONFIDENCE, OVERFILL = 400, 100, 5, 0.6, 0.5
#: USD for a million tokens, in and out, and the discount of the slow tier.
PRICES = {"gpt-5.4": (1.25, 10.0), "gpt-5.4-mini": (0.375, 3.0)}
FLEX = 0.5


def lookup(c: Column, table: dict, default) -> Column:
    """The table's value for the column, else the default."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c], F.lit(default))


def by_fraction(
    clusters: DataFrame, key: str, category: str, fractions: dict[str, float] = CATEGORY_FRACTION
) -> DataFrame:
    """Clusters kept by the fraction of their category; an unknown category keeps all."""
    return clusters.filter(keep_fraction(F.col(key).cast("string"), lookup(F.col(category), fractions, 1.0)))


def cost(calls: DataFrame, flex: Column, prices: dict[str, tuple[float, float]] = PRICES) -> Column:
    """USD of a call by its model and tokens; an unknown model costs nothing."""
    at = lambda k: lookup(F.col("model"), {m: p[k] for m, p in prices.items()}, 0.0)
    tier = F.when(flex, FLEX).otherwise(1.0)
    return (F.col("prompt_tokens") / 1e6 * at(0) + F.col("completion_tokens") / 1e6 * at(1)) * tier


def min_confidence() -> Column:
    return F.least(*(F.col(f"{a}_confidence") for a in AXES))


def prepared(picks: DataFrame, weights: dict[str, float] = CATEGORY_WEIGHT) -> DataFrame:
    """One row for each query, of the best category and then the surest, with weight, min_conf and conf_factor."""
    rows = picks.withColumns(
        {"category_weight": lookup(F.col("clinical_relevance"), weights, 0.0), "min_conf": min_confidence()}
    )
    rows = rows.withColumn("conf_factor", F.when(F.col("min_conf") >= 3, 1.0).otherwise(LOW_CONFIDENCE))
    return best_row(
        rows,
        ["query_key"],
        -F.col("category_weight"),
        -F.col("min_conf"),
        F.col("supercluster_id"),
        F.col("query_text"),
    )


def supply(picks: DataFrame) -> DataFrame:
    """How many picks each cell has: cell, n."""
    cells = F.explode(F.array(*(F.col(f"{a}_grade") for a in AXES))).alias("cell")
    return picks.select(cells).filter("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def shortfall(picks: DataFrame, targets: dict[str, int] = TARGETS) -> DataFrame:
    """cell, target, achieved and shortfall of every quota."""
    wanted = picks.sparkSession.createDataFrame(list(targets.items()), "cell string, target long")
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(wanted).join(supply(picks), "cell", "left").select(
        "cell", "target", n.alias("achieved"), F.greatest(F.lit(0), F.col("target") - n).alias("shortfall")
    )


def confidence_histogram(picks: DataFrame) -> DataFrame:
    """Rows of each confidence from 1 to 5 on each axis: axis, confidence, n."""
    long = picks.unpivot(
        [], [f"{a}_confidence" for a in AXES], "axis", "confidence"
    ).withColumn("axis", F.upper(F.substring_index("axis", "_", 1)))
    counts = long.groupBy("axis", "confidence").agg(F.count(F.lit(1)).alias("n"))
    grid = picks.sparkSession.createDataFrame(
        [(a.upper(), c) for a in AXES for c in range(1, 6)], "axis string, confidence int"
    )
    return grid.join(counts, ["axis", "confidence"], "left").select(
        "axis", "confidence", F.coalesce("n", F.lit(0)).alias("n")
    )


def histogram_of_counts(picks: DataFrame, cluster: str = "supercluster_id") -> DataFrame:
    """How many clusters have each number of picks."""
    return picks.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_picks")).groupBy("n_picks").agg(
        F.count(F.lit(1)).alias("n_clusters")
    )


def _greedy(rows: pd.DataFrame, total: int, buffer: int, targets: dict[str, int], cap: int) -> pd.DataFrame:
    """Scarce cells first, then the row of the largest need times quality, again and again; the first of equal ones.

    Rows of the same cells and quality are a kind, whose rows are chosen in order, those of full
    clusters passed over.  What a kind is worth never rises and its next row's place never falls, so a heap of
    kinds by what both were last shows the best one: it is the first for which both are still the same.
    """
    names = list(targets)
    place = {c: k for k, c in enumerate(names)}
    want = [float(targets[c]) for c in names]
    left = list(want)
    graded = zip(*(rows[f"{a}_grade"].tolist() for a in AXES), strict=True)
    worths = zip(rows["category_weight"].astype(float).tolist(), rows["conf_factor"].astype(float).tolist(), strict=True)
    members: dict[tuple, list[int]] = {}
    for k, (grades, (weight, factor)) in enumerate(zip(graded, worths, strict=True)):
        members.setdefault((tuple(place.get(c, -1) for c in grades), weight * factor), []).append(k)
    kinds, lists = list(members), list(members.values())
    cluster = rows["supercluster_id"].tolist()
    have = [0] * len(names)
    for (cells, _), own in members.items():
        for c in cells:
            if c >= 0:
                have[c] += len(own)
    nth, used, chosen = [0] * len(lists), Counter(), []

    def take(j: int, phase: str) -> None:
        k = lists[j][nth[j]]
        chosen.append((k, phase))
        nth[j] += 1
        used[cluster[k]] += 1
        for c in kinds[j][0]:
            if c >= 0:
                left[c] -= 1

    def rated(j: int) -> tuple[float, int, int] | None:
        """What the kind's next free row is worth, and its place."""
        while nth[j] < len(lists[j]) and used[cluster[lists[j][nth[j]]]] >= cap:
            nth[j] += 1
        if nth[j] == len(lists[j]):
            return None
        cells, quality = kinds[j]
        need = 0.0
        for c in cells:
            need += 0.0 if c < 0 else left[c] / want[c] if left[c] > 0 else -OVERFILL / want[c]
        return -(need * quality + 0.01 * quality), lists[j][nth[j]], j

    heap = [(own[0], j) for j, own in enumerate(lists)]
    heapq.heapify(heap)
    while heap and len(chosen) < total:
        j = heap[0][1]
        if any(c >= 0 and have[c] < want[c] and left[c] > 0 for c in kinds[j][0]):
            take(j, "scarce")
            if nth[j] < len(lists[j]):
                heapq.heapreplace(heap, (lists[j][nth[j]], j))
                continue
        heapq.heappop(heap)  # its cells are no longer short, or it has no more rows
    heap = [r for j in range(len(lists)) if (r := rated(j))]
    heapq.heapify(heap)
    for phase, n in (("greedy", total - len(chosen)), ("buffer", buffer)):
        while n > 0 and heap:
            j = heap[0][2]
            now = rated(j)
            if now == heap[0]:
                take(j, phase)
                n -= 1
                now = rated(j)
            if now is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, now)
    out = rows.iloc[[k for k, _ in chosen]].copy()
    out["phase"] = [p for _, p in chosen]
    out["order"] = np.arange(len(out))
    return out


def greedy_sample(
    picks: DataFrame,
    total: int = N_TOTAL,
    buffer: int = BUFFER,
    targets: dict[str, int] = TARGETS,
    cap: int = CLUSTER_CAP,
) -> DataFrame:
    """A sample that meets the quotas: query_key, phase (scarce, greedy or buffer) and order.

    Each choice depends on all before it, so one task makes them.  What reaches that task
    is bounded: rows differ only by their cells, cluster, weight and confidence, and
    beyond the sample's size no more rows of one such kind can ever be chosen; the first
    of each kind are passed on.
    """
    grades = [f"{a}_grade" for a in AXES]
    kind = ["supercluster_id", *grades, "category_weight", "conf_factor", "min_conf"]
    from sievelight.operators.ranking import head_per_group

    few = head_per_group(prepared(picks), kind, total + buffer, F.asc("query_key")).select("query_key", *kind)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(
            ["category_weight", "min_conf", "query_key"], ascending=[False, False, True]
        ).reset_index(drop=True)
        return _greedy(ordered, total, buffer, targets, cap)[["query_key", "phase", "order"]]

    return few.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        choose, "query_key string, phase string, order int"
    )


def agreement(verified: DataFrame, picks: DataFrame) -> DataFrame:
    """Verified queries against their picks: per-axis agreement, contradictions and whether the item is hard."""
    joined = verified.join(picks.select("query_key", *(f"{a}_grade" for a in AXES)), "query_key")
    agree = {a: F.coalesce(F.col(f"{a}_grade") == F.col(f"verifier_{a}_grade"), F.lit(False)) for a in AXES}
    against = [(F.col(f"{a}_grade") != f"{a.upper()}0") & ~F.col(f"verifier_{a}_axis_applicable") for a in AXES]
    total = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    out = joined.select(
        "query_key",
        *(f.alias(f"{a}_agree") for a, f in agree.items()),
        total(agree.values()).alias("n_axes_agreement"),
        total(against).alias("contradiction_count"),
    )
    return out.withColumn(
        "is_iaa_hard_candidate", (F.col("n_axes_agreement") <= 2) | (F.col("contradiction_count") > 0)
    )


def relevant_clusters(picks: DataFrame, axis: str, token: str, most: int) -> DataFrame:
    """Clusters with picks of the token, by the weight of their category and then their number."""
    own = picks.filter(F.col(f"{axis}_grade") == token).groupBy("supercluster_id").agg(
        F.count(F.lit(1)).alias("n_anchor"), F.min("clinical_relevance").alias("clinical_relevance")
    )
    return own.withColumn(
        "weight", lookup(F.col("clinical_relevance"), CATEGORY_WEIGHT, 0.0)
    ).orderBy(F.desc("weight"), F.desc("n_anchor"), "supercluster_id").limit(most)


def swap_candidates(base: DataFrame, n: int) -> DataFrame:
    """The ``n`` picks that go first: MU0 and PU0, by ET2, ET1, ET0, the least sure first."""
    rank = F.when(F.col("et_grade") == "ET2", 0).when(F.col("et_grade") == "ET0", 2).otherwise(1)
    pool = base.filter("mu_grade = 'MU0' and pu_grade = 'PU0'").withColumns({"_r": rank, "_c": min_confidence()})
    return pool.orderBy("_r", "_c", "category_weight", "query_key").limit(n).select("query_key")


def backfilled(base: DataFrame, kept: DataFrame) -> DataFrame:
    """The set with synthetic rows in place of as many removable picks."""
    from sievelight.operators.sets import swap

    n = kept.count()
    return swap(
        base.withColumn("origin", F.lit("picked")),
        swap_candidates(base, n),
        kept.withColumn("origin", F.lit("synthesized")),
        "query_key",
    )


def is_rare() -> Column:
    return (F.col("mu_grade") == "MU2") | (F.col("pu_grade") == "PU2")


def manifest(packed: DataFrame, agreed: DataFrame, prefix: str = "golden-v1:") -> DataFrame:
    """Every item with its package, source key and agreement."""
    extra = agreed.select("query_key", "n_axes_agreement", "is_iaa_hard_candidate")
    return packed.join(extra, "query_key", "left").withColumns(
        {
            "source": source_key(prefix, F.col("query_key")),
            "package": F.when(F.col("in_core"), "core").otherwise("extra"),
        }
    )


def packages(items: DataFrame) -> DataFrame:
    """A JSON document for each package: its queries by source."""
    held = F.array_sort(F.collect_list(F.struct("source", F.col("query_text").alias("text"))))
    return items.groupBy("package").agg(
        F.to_json(F.struct(held.alias("queries"))).alias("json"), F.count(F.lit(1)).alias("n")
    )


def resolved(ratings: DataFrame, item: str, value: str, adjudicated: str) -> DataFrame:
    """The gold of each item: what was adjudicated, else what all raters agree on, else null; and how it came about."""
    own = ratings.groupBy(item).agg(
        F.max(adjudicated).alias("a"), F.count_distinct(value).alias("k"), F.min(value).alias("v")
    )
    gold = F.coalesce("a", F.when(F.col("k") == 1, F.col("v")))
    how = F.when(F.col("a").isNotNull(), "adjudicated").when(F.col("k") == 1, "agreement").otherwise("unresolved")
    return own.select(item, gold.alias("gold"), how.alias("provenance"))


def raters_of(
    wide: DataFrame,
    axes=("MU", "PU", "ET"),
    least: int = 150,
    excluded=("gold", "llm_reference", "admin"),
    share: float = 0.0,
) -> list[str]:
    """Names of the raters whose columns hold at least ``least`` values, and that ``share`` of all rows, on every axis."""
    names = sorted(
        {
            c.rsplit("_", 1)[0]
            for c in wide.columns
            if c.rsplit("_", 1)[-1] in axes and not c.startswith(tuple(excluded))
        }
    )
    if not names:
        return []
    row = wide.agg(
        *(
            F.least(*(F.count(f"{n}_{a}") for a in axes if f"{n}_{a}" in wide.columns), F.lit(1 << 60)).alias(n)
            for n in names
        ),
        F.count(F.lit(1)).alias("_rows"),
    ).first()
    return [n for n in names if row[n] >= max(least, share * row[-1])]


def ratings_long(wide: DataFrame, key: str, raters: list[str], axes=("MU", "PU", "ET")) -> DataFrame:
    """key, rater, axis and grade from columns named after both."""
    cells = [
        F.struct(F.lit(r).alias("rater"), F.lit(a).alias("axis"), F.col(f"{r}_{a}").cast("int").alias("grade"))
        for r in raters
        for a in axes
        if f"{r}_{a}" in wide.columns
    ]
    every = F.array(*cells).cast("array<struct<rater:string,axis:string,grade:int>>")
    return wide.select(key, F.explode(every).alias("e")).select(key, "e.*")


def validated(rows: DataFrame, token: str, axis: str, confidence: str) -> DataFrame:
    """Rows with reject, the reason why a model's answer can't be used, or null."""
    reason = F.when(F.col(token).isNull(), "no grade").when(
        ~F.col(token).rlike("^" + axis + "[012]$"), "unknown grade"
    ).when(
        F.col(confidence).isNull() | ~F.col(confidence).between(1, 5), "confidence out of range"
    )
    return rows.withColumn("reject", reason)
