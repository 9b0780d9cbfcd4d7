"""What reports are made of: joins with a fallback, contingency tables, audits and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators import metrics as mx
from sievelight.operators.ranking import head_per_group

#: A kappa less than this below another is no worse.
TIE = 0.05


def matched_members(picks: DataFrame, members: DataFrame, text: str = "query_text") -> DataFrame:
    """Picks with the key of the member of their cluster that has their text, verbatim or folded.

    ``members`` has supercluster_id, query and query_key.  verbatim_match tells which it
    was; without either, the key is the folded text itself.
    """
    folded = tx.fold(F.col(text))
    exact = members.groupBy("supercluster_id", F.col("query").alias(text)).agg(F.min("query_key").alias("_exact"))
    near = members.groupBy(
        "supercluster_id", tx.fold(F.col("query")).alias("_fold")
    ).agg(F.min("query_key").alias("_near"))
    joined = picks.withColumn("_fold", folded).join(exact, ["supercluster_id", text], "left").join(
        near, ["supercluster_id", "_fold"], "left"
    )
    found = joined.withColumns(
        {"matched_key": F.coalesce("_exact", "_near", "_fold"), "verbatim_match": F.col("_exact").isNotNull()}
    )
    return found.drop("_fold", "_exact", "_near")


def axis_jobs(
    queries: DataFrame, axes: tuple[str, ...], done: DataFrame | None = None, key: str = "query_key"
) -> DataFrame:
    """A row for each query and axis that isn't done yet."""
    jobs = queries.select(key, F.explode(F.array(*map(F.lit, axes))).alias("axis"))
    return jobs if done is None else jobs.join(done.select(key, "axis").distinct(), [key, "axis"], "left_anti")


def contingency(df: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """Counts of each value of ``column``, 0 where there is none."""
    return df.groupBy(*rows).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def cluster_diversity(picks: DataFrame, cluster: str = "supercluster_id") -> DataFrame:
    """Picks with diversity, one over the number of picks of their cluster."""
    sizes = picks.groupBy(cluster).agg((1.0 / F.count(F.lit(1))).alias("diversity"))
    return picks.join(sizes, cluster)


def confidence_by_subset(df: DataFrame, subset: str, columns: list[str]) -> DataFrame:
    """Mean of the row means of some confidences, for each subset."""
    total = sum((F.col(c) for c in columns), F.lit(0))
    return df.groupBy(subset).agg(F.avg(total / len(columns)).alias("mean_confidence"), F.count(F.lit(1)).alias("n"))


def dominant(df: DataFrame, group: list[str], category: str) -> DataFrame:
    """The most frequent category of each group; ties go to the smaller name."""
    counts = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(category, F.struct((-F.col("n")).alias("a"), F.col(category).alias("b")))
    return counts.groupBy(*group).agg(best.alias(category))


def first_metric(*blocks: Column) -> Column:
    """The first metric block that is there: of real items, else of all."""
    return F.coalesce(*blocks)


def anchor_audit(assigned: DataFrame, words: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """Phrases at their nearest cluster, with its top words and most clicked queries, each joined in order.

    ``assigned`` has phrase, cluster_id and cosine; ``words`` cluster_id, term and weight;
    ``queries`` cluster_id, query and clicks.
    """

    def top(df: DataFrame, text: str, by: str, out: str) -> DataFrame:
        few = head_per_group(df.select("cluster_id", text, by), ["cluster_id"], n, F.desc(by), F.asc(text))
        held = F.array_sort(F.collect_list(F.struct("rank", text)))
        return few.groupBy("cluster_id").agg(F.array_join(F.transform(held, lambda s: s[text]), ", ").alias(out))

    audited = assigned.join(top(words, "term", "weight", "top_words"), "cluster_id", "left")
    return audited.join(top(queries, "query", "clicks", "top_queries"), "cluster_id", "left")


def benchmark(predictions: DataFrame, gold: DataFrame, by: list[str], key: str = "item") -> DataFrame:
    """Every system against the gold: by, n, macro_f1, qwk, agreement, n_missed and coverage.

    ``predictions`` has ``by``, the key and pred, which may be null; ``gold`` the key and
    gold.  All systems are one job.
    """
    joined = predictions.join(gold.filter("gold is not null").select(key, "gold"), key)
    counts = joined.groupBy(*by).agg(
        F.count("pred").alias("n"), F.avg(F.col("pred").isNotNull().cast("double")).alias("coverage")
    )
    rated = mx.confusion(joined, "gold", "pred", by).select(
        *by, mx.macro_f1_of().alias("macro_f1"), mx.qwk_of().alias("qwk"), mx.agreement_of().alias("agreement")
    )
    return counts.join(rated, by).join(mx.missed(joined, "gold", "pred", by), by)


def mode_verdict(
    cells: DataFrame, ceiling: DataFrame, baseline: str, singles: tuple[str, ...], tie: float = TIE
) -> DataFrame:
    """How each mode of an axis does against the baseline mode and against people.

    ``cells`` has axis, mode, head (dom or linear), qwk and qwk_lo; ``ceiling`` axis and
    human_qwk.  Returns axis, mode, dom, linear, the changes of both from the baseline's,
    best (the better head), signal (the direction's interval lies above 0), works (best is
    no more than ``tie`` below the baseline's direction), in_band (or below people's
    agreement), and holds: whether the mode is one of ``singles``, works and has an
    interval.
    """
    of = lambda head, c: F.max(F.when(F.col("head") == head, F.col(c)))
    wide = cells.groupBy("axis", "mode").agg(
        of("dom", "qwk").alias("dom"), of("linear", "qwk").alias("linear"), of("dom", "qwk_lo").alias("lo")
    )
    base = wide.filter(F.col("mode") == baseline).select(
        "axis", F.col("dom").alias("base_dom"), F.col("linear").alias("base_linear")
    )
    joined = wide.join(base, "axis", "left").join(ceiling.select("axis", "human_qwk"), "axis", "left")
    joined = joined.withColumn("best", F.greatest("dom", "linear"))
    no = F.lit(False)
    works = F.coalesce(F.col("best") >= F.col("base_dom") - tie, no)
    return joined.select(
        "axis",
        "mode",
        "dom",
        "linear",
        F.round(F.col("dom") - F.col("base_dom"), 3).alias("dom_change"),
        F.round(F.col("linear") - F.col("base_linear"), 3).alias("linear_change"),
        "best",
        F.coalesce(F.col("lo") > 0, no).alias("signal"),
        works.alias("works"),
        F.coalesce(F.col("best") >= F.col("human_qwk") - tie, no).alias("in_band"),
        (F.col("mode").isin(*singles) & works & F.col("lo").isNotNull()).alias("holds"),
    )


def pareto(points: DataFrame, cost: str, score: str) -> DataFrame:
    """Points with on_front: no other costs as little or less and scores as much or more, one of them truly."""
    best = points.groupBy(cost).agg(F.max(score).alias("_best"))
    cheaper = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)  # a row for each cost of a report
    before = best.withColumn("_before", F.max("_best").over(cheaper))
    on = (F.col(score) == F.col("_best")) & (F.col("_before").isNull() | (F.col(score) > F.col("_before")))
    return points.join(before, cost).withColumn("on_front", F.coalesce(on, F.lit(False))).drop("_best", "_before")


def two_levels(first: DataFrame, second: DataFrame) -> DataFrame:
    """What clusters become at two cutoffs: level, n_clusters, n_groups, n_absorbed, n_single, n_after, reduction.

    Both have category, cluster_id and merged.  A group has two clusters or more; what is
    left after a level are groups and single clusters.
    """
    both = first.withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2)))
    sizes = both.groupBy("level", "category", "merged").agg(F.count(F.lit(1)).alias("n"))
    several = F.col("n") > 1
    return sizes.groupBy("level").agg(
        F.sum("n").alias("n_clusters"),
        F.count_if(several).alias("n_groups"),
        F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("n_absorbed"),
        F.count_if(~several).alias("n_single"),
        F.count(F.lit(1)).alias("n_after"),
        F.round(100.0 * (F.sum("n") - F.count(F.lit(1))) / F.sum("n"), 6).alias("reduction"),
    )


def by_model(rows: DataFrame, keys: list[str], model: str, models: list[str], text: str) -> DataFrame:
    """The outputs of several generators side by side, and how many of them there are."""
    sides = [F.min(F.when(F.col(model) == m, F.col(text))).alias(m) for m in models]
    return rows.groupBy(*keys).agg(*sides, F.count_distinct(model).alias("n_models"))


def relevance_audit(clusters: DataFrame, relevance: str, size: str, clicks: str) -> DataFrame:
    """Clusters, queries and clicks of each relevance, and the share of queries."""
    counts = clusters.groupBy(relevance).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum(size).alias("n_queries"), F.sum(clicks).alias("clicks")
    )
    total = F.broadcast(counts.agg(F.sum("n_queries").alias("_total")))  # one row
    return counts.crossJoin(total).withColumn("share", 100.0 * F.col("n_queries") / F.col("_total")).drop("_total")


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)
