"""Linear probes over frozen embeddings: difference-of-means directions, thresholds, evaluation.

Rows have axis, text_id, v (array of doubles), grade, cluster, query_key, pair_key and
split.  Directions have one row for each cell, so they are joined by the cell's columns;
vectors and rows are matched by key and never by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import vectors as vx
from sievelight.operators import metrics as mx
from sievelight.sources.storage import settled

CELL = ["axis"]
QUANTILES = 60


def extreme_direction(rows: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Mean of grade 2 less mean of grade 0, at length 1: cell, w."""
    means = vx.mean_vector(rows.filter(F.col("grade").isin(0, 2)), [*cell, "grade"], "v", "m")
    both = means.groupBy(*cell).agg(
        F.max(F.when(F.col("grade") == 2, F.col("m"))).alias("hi"),
        F.max(F.when(F.col("grade") == 0, F.col("m"))).alias("lo"),
    )
    return both.filter("hi is not null and lo is not null").select(
        *cell, vx.unit(vx.minus(F.col("hi"), F.col("lo"))).alias("w")
    )


def one_vs_rest_directions(rows: DataFrame, cell: list[str] = CELL, grades=mx.GRADES) -> DataFrame:
    """For each grade the mean of its rows less that of all others, at length 1: cell, grade, w."""
    sides = rows.select(
        *cell,
        "v",
        F.explode(
            F.array(
                *(F.struct(F.lit(g).alias("grade"), (F.col("grade") == g).cast("int").alias("inside")) for g in grades)
            )
        ).alias("s"),
    ).select(*cell, "v", "s.*")
    means = vx.mean_vector(sides, [*cell, "grade", "inside"], "v", "m")
    both = means.groupBy(*cell, "grade").agg(
        F.max(F.when(F.col("inside") == 1, F.col("m"))).alias("a"),
        F.max(F.when(F.col("inside") == 0, F.col("m"))).alias("b"),
    )
    zero = F.transform(F.coalesce("a", "b"), lambda x: F.lit(0.0))
    return both.select(
        *cell,
        "grade",
        F.when(
            F.col("a").isNull() | F.col("b").isNull(), zero
        ).otherwise(vx.unit(vx.minus(F.col("a"), F.col("b")))).alias("w"),
    )


def paired_matches(rows: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Grade-2 rows with the grade-0 vector each is set against, and how it was found.

    That is the row's own anchor, if it has grade 0; else the mean of grade 0 in its
    cluster; else the mean of grade 0 in the cell.
    """
    zero = rows.filter(F.col("grade") == 0)
    anchor = zero.groupBy(*cell, F.col("query_key").alias("pair_key")).agg(F.max_by("v", "text_id").alias("anchor_v"))
    cluster = vx.mean_vector(zero, [*cell, "cluster"], "v", "cluster_v")
    everywhere = F.broadcast(vx.mean_vector(zero, list(cell), "v", "cell_v"))  # a row a cell
    two = rows.filter(F.col("grade") == 2).join(
        anchor, [*cell, "pair_key"], "left"
    ).join(cluster, [*cell, "cluster"], "left").join(everywhere, list(cell))
    path = F.when(F.col("anchor_v").isNotNull(), "anchor").when(
        F.col("cluster_v").isNotNull(), "cluster"
    ).otherwise("cell")
    return two.select(
        *cell,
        "text_id",
        path.alias("path"),
        vx.minus(F.col("v"), F.coalesce("anchor_v", "cluster_v", "cell_v")).alias("d"),
    )


def paired_direction(rows: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Mean difference of grade-2 rows and their matches, at length 1: cell, w."""
    return vx.mean_vector(
        paired_matches(rows, cell), list(cell), "d", "m"
    ).select(*cell, vx.unit(F.col("m")).alias("w"))


def project(rows: DataFrame, directions: DataFrame, cell: list[str] = CELL, out: str = "score") -> DataFrame:
    """Rows with the dot product of their vector and their cell's direction, to 12 digits after the point."""
    return rows.join(
        F.broadcast(directions.select(*cell, "w")), list(cell)
    ).withColumn(out, F.round(vx.dot(F.col("v"), F.col("w")), 12)).drop("w")


def predict_one_vs_rest(rows: DataFrame, directions: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Rows with ovr_pred, the grade of the largest projection; ties go to the smaller grade."""
    held = directions.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("grade", "w"))).alias("ws"))
    scores = F.transform("ws", lambda s: F.round(vx.dot(F.col("v"), s["w"]), 9))
    return rows.join(F.broadcast(held), list(cell)).withColumn(
        "ovr_pred", F.get(F.transform("ws", lambda s: s["grade"]), vx.argmax(scores))
    ).drop("ws")


def tune_thresholds(scored: DataFrame, cell: list[str] = CELL, quantiles: int = QUANTILES) -> DataFrame:
    """The two thresholds of the best macro-F1 on ``scored`` (cell, score, grade): cell, t1, t2, f1.

    Candidates are distinct quantiles from 0.02 to 0.98, t1 < t2; of equal F1 the
    smallest t1, then t2.  Without two of them both are the median.  Rows are first
    reduced to counts of grades between candidates; sums up to each then give the
    confusion of every pair, so the pairs cost the same for any number of rows.
    """
    at = [0.02 + 0.96 * k / (quantiles - 1) for k in range(quantiles)]
    found = mx.quantiles(scored, "score", [*at, 0.5], list(cell))
    rounded = F.transform("q", lambda x: F.round(x, 12))
    cuts = settled(
        found.select(
            *cell,
            F.array_distinct(F.slice(rounded, 1, quantiles)).alias("ts"),
            F.get(rounded, F.lit(quantiles)).alias("median"),
        )
    )
    # The place of a score: how many candidates are at or below it.
    place = F.aggregate("ts", F.lit(0), lambda n, t: n + (t <= F.col("score")).cast("int"))
    held = scored.join(F.broadcast(cuts), list(cell)).select(*cell, "grade", place.alias("place"))
    counts = settled(
        held.groupBy(*cell, "place").agg(*(F.count_if(F.col("grade") == g).alias(f"n{g}") for g in mx.GRADES))
    )
    below = Window.partitionBy(*cell).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # Of each candidate, the rows of each grade below it; places of no row take those of the next.
    edges = cuts.select(*cell, F.posexplode("ts").alias("k", "t")).withColumn("place", F.col("k") + 1)
    full = edges.join(counts, [*cell, "place"], "left").select(
        *cell, "k", "t", "place", *(F.coalesce(f"n{g}", F.lit(0)).alias(f"n{g}") for g in mx.GRADES)
    )
    first = counts.filter("place = 0").select(*cell, *(F.col(f"n{g}").alias(f"z{g}") for g in mx.GRADES))
    sums = full.join(first, list(cell), "left").select(
        *cell,
        "k",
        "t",
        *(
            (F.coalesce(F.col(f"z{g}"), F.lit(0)) + F.coalesce(F.sum(f"n{g}").over(below), F.lit(0))).alias(f"b{g}")
            for g in mx.GRADES
        ),
    )
    total = counts.groupBy(*cell).agg(*(F.sum(f"n{g}").alias(f"a{g}") for g in mx.GRADES))
    low = sums.select(
        *cell, F.col("k").alias("k1"), F.col("t").alias("t1"), *(F.col(f"b{g}").alias(f"x{g}") for g in mx.GRADES)
    )
    high = sums.select(
        *cell, F.col("k").alias("k2"), F.col("t").alias("t2"), *(F.col(f"b{g}").alias(f"y{g}") for g in mx.GRADES)
    )
    pairs = low.join(high, list(cell)).filter("k1 < k2").join(total, list(cell))
    for g in mx.GRADES:
        pairs = pairs.withColumns(
            {
                f"c_{g}_0": F.col(f"x{g}"),
                f"c_{g}_1": F.col(f"y{g}") - F.col(f"x{g}"),
                f"c_{g}_2": F.col(f"a{g}") - F.col(f"y{g}"),
            }
        )
    rated = pairs.withColumn("f1", F.round(mx.macro_f1_of(), 9))
    best = rated.groupBy(*cell).agg(
        F.min_by(
            F.struct("t1", "t2", "f1"),
            F.struct((-F.col("f1")).alias("a"), F.col("t1").alias("b"), F.col("t2").alias("c")),
        ).alias("b")
    )
    out = cuts.select(*cell, "median").join(best, list(cell), "left")
    return out.select(
        *cell,
        F.coalesce("b.t1", "median").alias("t1"),
        F.coalesce("b.t2", "median").alias("t2"),
        F.col("b.f1").alias("f1"),
    )


def classify(scored: DataFrame, thresholds: DataFrame, cell: list[str] = CELL) -> DataFrame:
    return scored.join(F.broadcast(thresholds.select(*cell, "t1", "t2")), list(cell)).withColumn(
        "pred", vx.three_class(F.col("score"), F.col("t1"), F.col("t2"))
    ).drop("t1", "t2")


def evaluate(rows: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Fit on train, tune on dev, report on test: cell, n_train, n_test, t1, t2, macro_f1, qwk, agreement.

    All cells in one job: nothing is collected, and only directions and thresholds, a row
    a cell, are broadcast.
    """
    direction = settled(paired_direction(rows.filter("split = 'train'"), cell))
    # Written once: the quantiles alone go over the scores several times.
    scored = settled(project(rows.filter("split <> 'train'"), direction, cell).select(*cell, "split", "grade", "score"))
    cuts = settled(tune_thresholds(scored.filter("split = 'dev'").select(*cell, "score", "grade"), cell))
    table = mx.confusion(classify(scored.filter("split = 'test'"), cuts, cell), "grade", "pred", list(cell))
    sizes = rows.groupBy(*cell).agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")
    )
    out = sizes.join(cuts, list(cell)).join(table, list(cell))
    return out.select(
        *cell,
        "n_train",
        "n_test",
        "t1",
        "t2",
        mx.macro_f1_of().alias("macro_f1"),
        mx.qwk_of().alias("qwk"),
        mx.agreement_of().alias("agreement"),
    )


def grade1_landing(pred: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Where rows of true grade 1 were put."""
    return pred.filter("grade = 1").groupBy(*cell).agg(
        *(F.count_if(F.col("pred") == g).alias(f"to_{g}") for g in mx.GRADES)
    )


def direction_cosines(directions: DataFrame, name: str = "axis") -> DataFrame:
    """Cosines of all pairs of a small table of directions."""
    a = directions.select(F.col(name).alias("a"), F.col("w").alias("aw"))
    b = directions.select(F.col(name).alias("b"), F.col("w").alias("bw"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", vx.cosine(F.col("aw"), F.col("bw")).alias("cosine"))


def upsert(results: DataFrame, new: DataFrame, cell: list[str]) -> DataFrame:
    """Results in which each cell of ``new`` replaces its old one."""
    return results.join(new.select(*cell).distinct(), cell, "left_anti").unionByName(new, allowMissingColumns=True)


def vectors_for(texts: DataFrame, vectors: DataFrame, key: str = "text_id") -> tuple[DataFrame, DataFrame]:
    """Texts with a vector, and the share of texts that have one: coverage, n."""
    found = vectors.select(key, F.lit(True).alias("_found")).distinct()
    coverage = texts.join(found, key, "left").agg(
        F.avg(F.coalesce("_found", F.lit(False)).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n")
    )
    return texts.join(vectors, key), coverage


def concatenated(cells: list[DataFrame], key: str = "text_id", vector: str = "v") -> DataFrame:
    """The vectors of texts that every cell has, one after another."""
    out = cells[0].select(key, F.col(vector).alias("_v0"))
    for k, cell in enumerate(cells[1:], 1):
        out = out.join(cell.select(key, F.col(vector).alias(f"_v{k}")), key)
    return out.select(key, F.concat(*(f"_v{k}" for k in range(len(cells)))).alias(vector))


def topic_orthogonality(rows: DataFrame, directions: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """How far topics lie along the direction: cell, n_topics, mean_abs, p95_abs, max_abs.

    A topic's direction is the mean of its grade-0 members, if there are three, or of all
    of them, if there are five, less the mean of all rows; other topics are left out.
    """
    sizes = rows.groupBy(*cell, "cluster").agg(
        F.count_if(F.col("grade") == 0).alias("n0"), F.count(F.lit(1)).alias("n")
    )
    used = sizes.filter("n0 >= 3 or n >= 5").select(*cell, "cluster", (F.col("n0") >= 3).alias("zero_only"))
    chosen = rows.join(used, [*cell, "cluster"]).filter("not zero_only or grade = 0")
    topics = vx.mean_vector(chosen, [*cell, "cluster"], "v", "m")
    everywhere = F.broadcast(vx.mean_vector(rows, list(cell), "v", "all_m"))  # a row a cell
    along = topics.join(everywhere, list(cell)).join(F.broadcast(directions.select(*cell, "w")), list(cell))
    cosines = along.select(*cell, F.abs(vx.cosine(vx.minus(F.col("m"), F.col("all_m")), F.col("w"))).alias("c"))
    return cosines.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_topics"),
        F.avg("c").alias("mean_abs"),
        F.percentile("c", F.lit(0.95)).alias("p95_abs"),
        F.max("c").alias("max_abs"),
    )


def topic_verdict(orthogonality: DataFrame, eta: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """entangled if the factor explains over half of the variance or the mean cosine is over 0.3, mixed over 0.15, else separate."""
    verdict = F.when(
        F.col("eta_squared") > 0.5, "entangled"
    ).when(F.col("mean_abs") > 0.3, "entangled").when(F.col("mean_abs") > 0.15, "mixed").otherwise("separate")
    return orthogonality.join(eta, list(cell)).withColumn("verdict", verdict)


def ordinal_gap(rows: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Two thresholds on one direction against a direction for each grade: cell, f1_ordinal, f1_nominal, gap.

    Directions are fitted on train and thresholds tuned on dev; both are judged on test.
    """
    ordinal = evaluate(rows, cell).select(*cell, F.col("macro_f1").alias("f1_ordinal"))
    directions = settled(one_vs_rest_directions(rows.filter("split = 'train'"), cell))
    told = predict_one_vs_rest(rows.filter("split = 'test'"), directions, cell)
    nominal = mx.confusion(told, "grade", "ovr_pred", list(cell)).select(*cell, mx.macro_f1_of().alias("f1_nominal"))
    return ordinal.join(nominal, list(cell)).withColumn("gap", F.col("f1_nominal") - F.col("f1_ordinal"))


def ordinality(scored: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Mean projection of each grade and whether they rise: cell, mean_0, mean_1, mean_2, monotone."""
    means = scored.groupBy(*cell).agg(
        *(F.avg(F.when(F.col("grade") == g, F.col("score"))).alias(f"mean_{g}") for g in mx.GRADES)
    )
    return means.withColumn("monotone", (F.col("mean_0") < F.col("mean_1")) & (F.col("mean_1") < F.col("mean_2")))


def shuffled_grades(rows: DataFrame, seed: int, key: str, cell: list[str] = CELL) -> DataFrame:
    """Rows whose grades are permuted within each cell: the k-th row by key takes the grade of the k-th by seeded hash."""
    from sievelight.functions.hashing import seeded

    by_key = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*cell).orderBy(key)))
    by_hash = rows.select(*cell, "grade", key).withColumn(
        "_k", F.row_number().over(Window.partitionBy(*cell).orderBy(seeded(seed, F.col(key)), key))
    )
    return by_key.drop("grade").join(by_hash.select(*cell, "_k", "grade"), [*cell, "_k"]).drop("_k")


def selectivity(rows: DataFrame, key: str = "text_id", shuffles: int = 5, cell: list[str] = CELL) -> DataFrame:
    """Macro-F1 of the extreme direction against that on permuted training grades: cell, real_f1, mean_f1, std_f1, gap.

    All permutations are one job: the number of the permutation is one more column of the cell.
    """
    every = rows.withColumn("shuffle", F.lit(0))
    train = rows.filter("split = 'train'")
    for s in range(1, shuffles + 1):
        every = every.unionByName(
            shuffled_grades(train, s, key, cell).unionByName(
                rows.filter("split <> 'train'")
            ).withColumn("shuffle", F.lit(s))
        )
    wide = [*cell, "shuffle"]
    scored = project(every, settled(extreme_direction(every.filter("split = 'train'"), wide)), wide)
    cuts = settled(tune_thresholds(scored.filter("split = 'dev'").select(*wide, "score", "grade"), wide))
    f1 = mx.confusion(
        classify(scored.filter("split = 'test'"), cuts, wide), "grade", "pred", wide
    ).select(*wide, mx.macro_f1_of().alias("f1"))
    fake = F.when(F.col("shuffle") > 0, F.col("f1"))
    out = f1.groupBy(*cell).agg(
        F.max(F.when(F.col("shuffle") == 0, F.col("f1"))).alias("real_f1"),
        F.avg(fake).alias("mean_f1"),
        F.stddev_pop(fake).alias("std_f1"),
    )
    return out.withColumn("gap", F.col("real_f1") - F.col("mean_f1"))


def counterfactual(edits: DataFrame, scores: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """How edits move the projection, in deviations of the seeds' scores.

    ``edits`` has cell, seed, paraphrase, up and down (ids); ``scores`` has cell, text_id
    and score.  Returns cell, n, invariance (mean |change| of paraphrases), sensitivity
    (mean |change| of flips), ratio and direction_correct.
    """
    of = lambda name: scores.select(*cell, F.col("text_id").alias(name), F.col("score").alias(f"s_{name}"))
    joined = edits.join(of("seed"), [*cell, "seed"])
    for name in ("paraphrase", "up", "down"):
        joined = joined.join(of(name), [*cell, name], "left")
    spread = F.broadcast(joined.groupBy(*cell).agg(F.stddev_pop("s_seed").alias("sd")))  # a row a cell
    moved = joined.join(spread, list(cell))
    change = lambda name: (F.col(f"s_{name}") - F.col("s_seed")) / F.nullif("sd", F.lit(0.0))
    moved = moved.select(*cell, *(change(name).alias(f"d_{name}") for name in ("paraphrase", "up", "down")))
    flips = F.array_compact(F.array(F.col("d_up"), -F.col("d_down")))
    per = moved.select(
        *cell,
        F.abs("d_paraphrase").alias("p"),
        F.aggregate(flips, F.lit(0.0), lambda a, x: a + F.abs(x)).alias("f"),
        F.size(flips).alias("n_f"),
        F.size(F.filter(flips, lambda x: x > 0)).alias("right"),
    )
    out = per.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("p").alias("invariance"),
        (F.sum("f") / F.nullif(F.sum("n_f"), F.lit(0))).alias("sensitivity"),
        (F.sum("right") / F.nullif(F.sum("n_f"), F.lit(0))).alias("direction_correct"),
    )
    return out.withColumn("ratio", F.col("sensitivity") / F.nullif("invariance", F.lit(0.0)))


def class_weights(rows: DataFrame, label: str = "grade") -> Column:
    """n / (k * n_c) for each class, as a column; a table has few classes."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    n, k = sum(counts.values()), len(counts)
    pairs = [x for c, m in counts.items() for x in (F.lit(c), F.lit(n / (k * m)))]
    return F.create_map(*pairs)[F.col(label)]
