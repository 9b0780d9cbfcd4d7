"""Agreement, ranking and robustness statistics over tables of labels.

Each function takes the columns that name a cell (an embedder, mode and axis, say) as
``by`` and returns one row for each, so all cells are one job.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.hashing import uniform_long
from sievelight.sources.storage import settled

GRADES = (0, 1, 2)


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def group(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def confusion(df: DataFrame, true: str, pred: str, by: list[str] = (), grades=GRADES) -> DataFrame:
    """One row a cell with a count column c_i_j for true i and predicted j; rows with a null are left out."""
    cells = [F.count_if((F.col(true) == i) & (F.col(pred) == j)).alias(f"c_{i}_{j}") for i in grades for j in grades]
    return group(df, list(by), *cells)


def confusion_long(df: DataFrame, true: str, pred: str, by: list[str] = (), grades=GRADES) -> DataFrame:
    """The dense matrix as rows: true, pred, n."""
    cells = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("true"), F.lit(j).alias("pred"), F.col(f"c_{i}_{j}").alias("n"))
                for i in grades
                for j in grades
            )
        )
    )
    return confusion(df, true, pred, by, grades).select(*by, cells.alias("e")).select(*by, "e.*")


def f1_of(grade: int, grades=GRADES) -> Column:
    """F1 of a grade from a confusion row; 0 where it is undefined."""
    hit = F.col(f"c_{grade}_{grade}")
    both = _sum(F.col(f"c_{grade}_{j}") for j in grades) + _sum(F.col(f"c_{i}_{grade}") for i in grades)
    return F.when(both == 0, 0.0).otherwise(2.0 * hit / both)


def macro_f1_of(grades=GRADES) -> Column:
    """Mean of the F1 of all grades, those that never occur included."""
    return _sum(f1_of(g, grades) for g in grades) / float(len(grades))


def qwk_of(grades=GRADES) -> Column:
    """Quadratic-weighted kappa from a confusion row; null where chance agreement is whole."""
    c = lambda i, j: F.col(f"c_{i}_{j}")
    n = _sum(c(i, j) for i in grades for j in grades)
    rows = {i: _sum(c(i, j) for j in grades) for i in grades}
    cols = {j: _sum(c(i, j) for i in grades) for j in grades}
    seen = _sum(float((i - j) ** 2) * c(i, j) for i in grades for j in grades if i != j)
    chance = _sum(float((i - j) ** 2) * rows[i] * cols[j] for i in grades for j in grades if i != j)
    return 1.0 - seen * n / F.nullif(chance, F.lit(0.0))


def kappa_of(grades=GRADES) -> Column:
    """Cohen's kappa without weights; null where chance agreement is whole."""
    c = lambda i, j: F.col(f"c_{i}_{j}")
    n = F.nullif(_sum(c(i, j) for i in grades for j in grades), F.lit(0))
    agreed = _sum(c(i, i) for i in grades) / n
    chance = _sum(_sum(c(i, j) for j in grades) * _sum(c(k, i) for k in grades) for i in grades) / (n * n)
    return (agreed - chance) / F.nullif(1.0 - chance, F.lit(0.0))


def agreement_of(grades=GRADES) -> Column:
    c = lambda i, j: F.col(f"c_{i}_{j}")
    return _sum(c(i, i) for i in grades) / F.nullif(_sum(c(i, j) for i in grades for j in grades), F.lit(0))


def _beside(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Rows of ``a`` with those of ``b`` that have the same keys, null ones too; without keys ``b`` has one row."""
    if not by:
        return a.crossJoin(b)
    named = b.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by))
    return a.join(named, same, how).drop(*(f"_of_{c}" for c in by))


def ranked_values(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """by, the distinct values, _n, the rows of each, and _before, the rows of lesser ones.

    Rows are reduced to counts of distinct values, which are dealt out by ranges.  The
    sums of whole ranges, a row for each of them, come before those within a range, so no
    task orders more than one range however many values there are.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(*by, value)
    counts = settled(counts.withColumn("_range", F.spark_partition_id()))
    ranges = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_in_range"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "_range", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).alias("_before_range"))
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before_range") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    placed = _beside(counts, ranges, [*by, "_range"])
    return placed.select(*by, value, "_n", before.alias("_before"))


def midranks(df: DataFrame, value: str, by: list[str] = (), out: str = "r") -> DataFrame:
    """Ranks in which ties share their mean."""
    ranks = ranked_values(df, value, by).withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2.0)
    return df.join(ranks.select(*by, value, out), [*by, value])


def quantiles(df: DataFrame, value: str, at: list[float], by: list[str] = ()) -> DataFrame:
    """by and q, the interpolated quantiles at each of ``at``: those of ``percentile``.

    Values are ranked over ranges, so no task and no buffer holds the values of a cell; of
    each cell only those at the wanted places come together.
    """
    ranked = ranked_values(df.filter(F.col(value).isNotNull()), value, by)
    sizes = F.broadcast(group(ranked, list(by), F.sum("_n").alias("_all")))  # a row a cell
    held = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
    # One small expression over an array of the wanted places: one for each place would take longer to compile than to run.
    places = F.transform(F.lit([float(q) for q in at]), lambda q, k: F.struct(k.alias("k"), ((F.col("_all") - 1) * q).alias("p")))
    marks = F.filter(places, lambda m: held(F.floor(m["p"])) | held(F.ceil(m["p"])))
    hits = _beside(ranked, sizes, by).select(*by, value, "_before", "_n", F.explode(marks).alias("m"))
    low, high = held(F.floor("m.p")), held(F.ceil("m.p"))
    ends = hits.groupBy(*by, F.col("m.k").alias("k"), F.col("m.p").alias("p")).agg(
        F.max(F.when(low, F.col(value))).alias("lo"), F.max(F.when(high, F.col(value))).alias("hi")
    )
    between = (F.ceil("p") - F.col("p")) * F.col("lo") + (F.col("p") - F.floor("p")) * F.col("hi")
    own = ends.select(*by, "k", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(between).alias("x"))
    held = F.array_sort(F.collect_list(F.struct("k", "x")))  # one for each of ``at``
    return group(own, list(by), F.transform(held, lambda s: s["x"]).alias("q"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Rank correlation with mid-ranks: by, spearman."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = midranks(midranks(both, x, by, "_rx"), y, by, "_ry")
    return group(ranked, list(by), F.corr("_rx", "_ry").alias("spearman"))


def auroc(df: DataFrame, score: str, positive: Column, by: list[str] = ()) -> DataFrame:
    """Area under the curve from the positives' mid-ranks: by, auroc; null with one class alone."""
    ranked = midranks(df.withColumn("_p", positive), score, by, "_r")
    p = F.count_if("_p")
    n = F.count(F.lit(1)) - p
    area = (F.sum(F.when(F.col("_p"), F.col("_r"))) - p * (p + 1) / 2.0) / F.nullif((p * n).cast("double"), F.lit(0.0))
    return group(ranked, list(by), area.alias("auroc"))


def krippendorff_alpha(ratings: DataFrame, unit: str, value: str, by: list[str] = ()) -> DataFrame:
    """Alpha at interval level: by, alpha.  Units with one rating are left out.

    Sums of squares of pairs follow from sums and sums of squares, so no pair is formed.
    """
    own = ratings.filter(F.col(value).isNotNull()).groupBy(*by, unit).agg(
        F.count(F.lit(1)).alias("m"),
        F.sum(F.col(value).cast("double")).alias("s"),
        F.sum(F.col(value).cast("double") * F.col(value)).alias("q"),
    ).filter("m > 1")
    within = F.sum((F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1))
    n, s, q = F.sum("m"), F.sum("s"), F.sum("q")
    expected = (n * q - s * s) / (n - 1)
    return group(own, list(by), (1.0 - within / F.nullif(expected, F.lit(0.0))).alias("alpha"))


def bootstrap_qwk(
    df: DataFrame, true: str, pred: str, key: str, resamples: int = 1000, by: list[str] = ()
) -> DataFrame:
    """Median and 95 % interval of the kappa over resamples by hashed draws: by, n_used, low, median, high.

    Draw i of resample b takes row md5(b:i) mod n in the order of ``key``.  Rows are
    reduced to labels by their place first; resamples with one true label are skipped.
    """
    rows = df.filter(F.col(true).isNotNull() & F.col(pred).isNotNull()).select(*by, key, true, pred)
    placed = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1)
    sizes = group(placed, list(by), F.count(F.lit(1)).alias("_n"))
    sized = placed.select(
        *by, F.col("_i").alias("_draw")
    ).join(sizes, list(by)) if by else placed.select(F.col("_i").alias("_draw")).crossJoin(F.broadcast(sizes))
    # The numbering leaves all rows in one task; their draws are dealt out again.
    sized = sized.repartition(df.sparkSession.sparkContext.defaultParallelism)
    draws = sized.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = draws.withColumn("_i", (uniform_long(F.md5(F.concat_ws(":", "_b", "_draw"))) % F.col("_n")).cast("int"))
    labelled = drawn.select(*by, "_b", "_i").join(placed.select(*by, "_i", true, pred), [*by, "_i"])
    each = confusion(labelled, true, pred, [*by, "_b"])
    labels = _sum((_sum(F.col(f"c_{i}_{j}") for j in GRADES) > 0).cast("int") for i in GRADES)
    values = each.filter(labels > 1).withColumn("_k", qwk_of())
    at = lambda q, name: F.percentile("_k", F.lit(q)).alias(name)
    return group(
        values, list(by), F.count("_k").alias("n_used"), at(0.025, "low"), at(0.5, "median"), at(0.975, "high")
    )


def bootstrap_qwk_counts(
    df: DataFrame, true: str, pred: str, resamples: int = 1000, by: list[str] = (), seed: int = 0
) -> DataFrame:
    """The same interval for tables of any size: by, n_used, low, median, high.

    The kappa depends on the confusion matrix alone, so a resample of the rows is a
    multinomial draw of its nine counts; one row a cell is all that leaves the table.
    """
    columns = [f"c_{i}_{j}" for i in GRADES for j in GRADES]
    counts = confusion(df, true, pred, by)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(GRADES)
        weight = (np.subtract.outer(np.arange(k), np.arange(k)) ** 2).astype(float)
        for frame in frames:
            out = []
            for cell in frame.to_dict("records"):
                row = np.array([cell[c] for c in columns])
                n = int(row.sum())
                made = np.random.default_rng(seed).multinomial(n, row / max(n, 1), resamples).reshape(-1, k, k) if n else []
                values = []
                for m in made:
                    chance = (weight * np.outer(m.sum(1), m.sum(0))).sum()
                    if (m.sum(1) > 0).sum() > 1 and chance > 0:
                        values.append(1 - n * (weight * m).sum() / chance)
                at = np.quantile(values, [0.025, 0.5, 0.975]) if values else [None] * 3
                out.append((*(cell[c] for c in by), len(values), *at))
            yield pd.DataFrame(out, columns=[*by, "n_used", "low", "median", "high"])

    schema = counts.select(*by).schema.add("n_used", T.LongType())
    for name in ("low", "median", "high"):
        schema = schema.add(name, T.DoubleType())
    return counts.mapInPandas(draw, schema)


def eta_squared(df: DataFrame, value: str, factor: str, by: list[str] = ()) -> DataFrame:
    """Share of the variance that a factor explains: by, eta_squared.  One pass over groups' sums."""
    x = F.col(value).cast("double")
    own = df.filter(x.isNotNull()).groupBy(*by, factor).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")
    )
    n, s = F.sum("n"), F.sum("s")
    mean = s * s / n
    return group(
        own,
        list(by),
        ((F.sum(F.col("s") * F.col("s") / F.col("n")) - mean) / (F.sum("q") - mean + 1e-12)).alias("eta_squared"),
    )


def latency(calls: DataFrame, seconds: str = "latency_s", by: list[str] = ()) -> DataFrame:
    """n, mean, median, p95, least and most of the calls that came back."""
    own = calls.filter(F.col(seconds).isNotNull()).select(*by, F.col(seconds).cast("double").alias("_s"))
    sums = group(
        own,
        list(by),
        F.count(F.lit(1)).alias("n"),
        F.avg("_s").alias("mean"),
        F.min("_s").alias("least"),
        F.max("_s").alias("most"),
    )
    q = lambda k, name: F.get("q", F.lit(k)).alias(name)
    return _beside(sums, quantiles(own, "_s", [0.5, 0.95], by), by).select(
        *by, "n", "mean", q(0, "median"), q(1, "p95"), "least", "most"
    )


def projection_latency(dim: int = 4096, n: int = 20_000, seed: int = 0) -> dict[str, float]:
    """Microseconds that one projection takes in a batch of ``n``, and the dimension; a timing, not a query."""
    rng = np.random.default_rng(seed)
    x, w = rng.standard_normal((n, dim), np.float32), rng.standard_normal(dim, np.float32)
    began = time.perf_counter()
    x @ w
    return {"us_per_query": (time.perf_counter() - began) / n * 1e6, "dim": dim}


def per_second(runs: DataFrame, n: str, seconds: str, by: list[str] = ()) -> DataFrame:
    """Items a second and milliseconds an item of runs, each with a number of items and a wall time."""
    items, wall = F.sum(n), F.sum(seconds)
    return group(
        runs,
        list(by),
        (items / F.nullif(wall, F.lit(0.0))).alias("per_second"),
        (1000.0 * wall / F.nullif(items, F.lit(0))).alias("ms_each"),
    )


def histogram(df: DataFrame, value: str, bins: int = 31) -> DataFrame:
    """Counts in equal bins between the least and the largest value: bin (from 0), n."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    place = F.least(
        F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)
    )
    placed = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).select(
        F.coalesce(place, F.lit(0)).cast("int").alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n")
    )


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """least, q1, median, q3, most and n of each group; nulls count in n alone."""
    sums = df.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))
    parts = quantiles(df.withColumn("_x", F.col(value).cast("double")), "_x", [0.25, 0.5, 0.75], by)
    q = lambda k, name: F.get("q", F.lit(k)).alias(name)
    return _beside(sums, parts, by, "left").select(
        *by, "least", q(0, "q1"), q(1, "median"), q(2, "q3"), "most", "n"
    )


def best_cell(metrics: DataFrame, by: list[str], metric: str, *ties: str) -> DataFrame:
    """The row of the largest metric of each group; ties go to the smaller of the other columns."""
    others = [c for c in metrics.columns if c not in by]
    order = F.struct((-F.col(metric)).alias("m"), *(F.col(t).alias(f"t_{t}") for t in ties))
    return metrics.filter(F.col(metric).isNotNull()).groupBy(*by).agg(
        F.min_by(F.struct(*others), order).alias("r")
    ).select(*by, "r.*")


def mode_delta(
    metrics: DataFrame, keys: list[str], mode: str, baseline: str, metric: str, band: float = 0.02
) -> DataFrame:
    """The change of the metric from the baseline mode and its verdict: better, worse or even."""
    base = metrics.filter(F.col(mode) == baseline).select(*keys, F.col(metric).alias("_base"))
    delta = F.col(metric) - F.col("_base")
    verdict = F.when(delta > band, "better").when(delta < -band, "worse").otherwise("even")
    return metrics.filter(F.col(mode) != baseline).join(base, keys).select(
        *keys, mode, delta.alias("delta"), verdict.alias("verdict")
    )


def missed(df: DataFrame, true: str, pred: str, by: list[str] = (), grade: int = 2) -> DataFrame:
    """How often the top grade was taken for 0: by, n_missed, n_true."""
    top = F.col(true) == grade
    return group(df, list(by), F.count_if(top & (F.col(pred) == 0)).alias("n_missed"), F.count_if(top).alias("n_true"))


def caught_by_other(a: DataFrame, b: DataFrame, key: str, true: str, pred: str, grade: int = 2) -> DataFrame:
    """Keys of top grade that ``b`` misses and ``a`` doesn't."""
    miss = lambda df: df.filter((F.col(true) == grade) & (F.col(pred) == 0)).select(key)
    return miss(b).join(miss(a), key, "left_anti")


def cost_curves(calls: DataFrame, prices: dict[str, tuple[float, float]], by: list[str], most: int = 15) -> DataFrame:
    """by, n_axes, model and cost: what judging the rows of ``calls`` costs for 1 to ``most`` axes.

    A model has a price for each row and one for each row and axis.  Rows are counted
    first, so what is multiplied is a row for each group.
    """
    each = F.array(
        *(F.struct(F.lit(k).alias("model"), F.lit(float(a)).alias("fixed"), F.lit(float(b)).alias("each")) for k, (a, b) in prices.items())
    )
    counted = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    every = counted.select(*by, "_n", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n_axes"))
    return every.select(*by, "_n", "n_axes", F.explode(each).alias("m")).select(
        *by, "n_axes", "m.model", (F.col("_n") * (F.col("m.fixed") + F.col("m.each") * F.col("n_axes"))).alias("cost")
    )
