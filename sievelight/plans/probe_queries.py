"""Queries over linear probes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import vectors as vx
from sievelight.operators import heads
from sievelight.operators import metrics as mx
from sievelight.operators import probes as pr
from sievelight.plans import views
from sievelight.plans.views import with_views
from sievelight.sources.storage import settled


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter("split = 'train'")


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("w").alias("place", "x")).withColumn("x", F.round("x", 6))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pairs(spark, sf_dir)
    return pr.project(rows, settled(pr.paired_direction(_train(rows))))


def _tuned(scored: DataFrame) -> DataFrame:
    return settled(pr.tune_thresholds(settled(scored.filter("split = 'dev'").select("axis", "score", "grade"))))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return pr.classify(scored.filter("split = 'test'"), _tuned(scored))


def pair_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.paired_matches(
        _train(views.pairs(spark, sf_dir))
    ).groupBy("axis", "path").agg(F.count(F.lit(1)).alias("n"))


def paired_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pr.paired_direction(_train(views.pairs(spark, sf_dir))), "axis")


def extreme_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pr.extreme_direction(_train(views.pairs(spark, sf_dir))), "axis")


def ovr_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pr.one_vs_rest_directions(_train(views.pairs(spark, sf_dir))), "axis", "grade")


def ovr_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pairs(spark, sf_dir)
    found = pr.predict_one_vs_rest(rows.filter("split = 'test'"), pr.one_vs_rest_directions(_train(rows)))
    return found.select("text_id", "axis", "ovr_pred")


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("text_id", "axis", F.round("score", 6).alias("score"))


def threshold_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuned(_scored(spark, sf_dir)).select("axis", *(F.round(c, 6).alias(c) for c in ("t1", "t2", "f1")))


def probe_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pr.evaluate(views.pairs(spark, sf_dir))
    return out.select(
        "axis", "n_train", "n_test", *(F.round(c, 6).alias(c) for c in ("t1", "t2", "macro_f1", "qwk", "agreement"))
    )


def grade1_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.grade1_landing(_classified(spark, sf_dir))


def direction_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.direction_cosines(
        pr.paired_direction(_train(views.pairs(spark, sf_dir)))
    ).withColumn("cosine", F.round("cosine", 6))


def residualize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = pr.paired_direction(_train(views.pairs(spark, sf_dir)))
    mu = F.broadcast(w.filter("axis = 'MU'").select(F.col("w").alias("mu")))  # one row
    return _flat(
        w.filter("axis <> 'MU'").crossJoin(mu).select("axis", vx.residual(F.col("w"), F.col("mu")).alias("w")), "axis"
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = views.picks(spark, sf_dir).select(F.col("query_key").cast("long").alias("text_id"))
    return pr.vectors_for(texts, views.pairs(spark, sf_dir))[1].withColumn("coverage", F.round("coverage", 6))


def concatenated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pairs(spark, sf_dir).select("text_id", "v")
    both = pr.concatenated([rows, rows.filter("text_id % 2 = 0"), rows.filter("text_id % 3 = 0")])
    return both.select("text_id", F.size("v").alias("dim"), F.round(vx.dot(F.col("v"), F.col("v")), 5).alias("squared"))


def results_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.pairs(spark, sf_dir).groupBy("axis", "split").agg(F.count(F.lit(1)).alias("n"))
    return pr.upsert(cells, cells.filter("split = 'dev'").withColumn("n", -F.col("n")), ["axis", "split"])


def topic_orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _train(views.pairs(spark, sf_dir))
    found = pr.topic_orthogonality(rows, pr.paired_direction(rows))
    return found.select("axis", "n_topics", *(F.round(c, 6).alias(c) for c in ("mean_abs", "p95_abs", "max_abs")))


def ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pr.ordinality(_scored(spark, sf_dir).filter("split = 'test'"))
    return found.select("axis", *(F.round(f"mean_{g}", 6).alias(f"mean_{g}") for g in mx.GRADES), "monotone")


def ordinal_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pr.ordinal_gap(views.pairs(spark, sf_dir))
    return out.select("axis", *(F.round(c, 6).alias(c) for c in ("f1_ordinal", "f1_nominal", "gap")))


def topic_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far topics lie along each direction, how much of the scores they explain, and what follows."""
    rows = views.pairs(spark, sf_dir)
    direction = settled(pr.paired_direction(_train(rows)))
    eta = mx.eta_squared(pr.project(_train(rows), direction), "score", "cluster", ["axis"])
    found = pr.topic_verdict(pr.topic_orthogonality(_train(rows), direction), eta)
    return found.select("axis", *(F.round(c, 6).alias(c) for c in ("mean_abs", "eta_squared")), "verdict")


def selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pr.selectivity(views.pairs(spark, sf_dir))
    return out.select("axis", *(F.round(c, 6).alias(c) for c in ("real_f1", "mean_f1", "std_f1", "gap")))


def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pr.counterfactual(views.edits(spark, sf_dir), _scored(spark, sf_dir).select("axis", "text_id", "score"))
    return out.select(
        "axis", "n", *(F.round(c, 6).alias(c) for c in ("invariance", "sensitivity", "direction_correct", "ratio"))
    )


def _head(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    rows = views.pairs(spark, sf_dir).select("text_id", "grade", "split", "v")
    found = fit(settled(rows.filter("split <> 'test'")), rows.filter("split = 'test'"))
    return mx.confusion_long(found, "grade", "pred")


def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _head(spark, sf_dir, heads.linear_head)


def ordinal_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _head(spark, sf_dir, heads.ordinal_head)


def mlp_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _head(spark, sf_dir, heads.mlp_head)


def whitened_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _head(spark, sf_dir, heads.whitened_head)


def score_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = settled(_scored(spark, sf_dir).select("text_id", "grade", "split", "score"))
    found = heads.score_head(scored.filter("split <> 'test'"), scored.filter("split = 'test'"))
    return mx.confusion_long(found, "grade", "pred")


def concat_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head on the vectors of two embedders, here a vector and its cumulated one."""
    rows = views.pairs(spark, sf_dir)
    sums = F.transform("v", lambda x, i: F.aggregate(F.slice("v", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y))
    cells = [rows.select("text_id", "v"), rows.select("text_id", sums.alias("v"))]
    return mx.confusion_long(heads.concat_head(cells, rows), "grade", "pred")


def head_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.compared(views.pairs(spark, sf_dir), ("MU", "PU", "ET"))


_UNIT = "[x / sqrt(list_dot_product(m, m)) for x in m]"
_EXTREME = f"SELECT axis, {_UNIT} AS w FROM (SELECT axis, list(d ORDER BY i) AS m FROM (SELECT axis, i, avg(v[i]) FILTER (grade = 2) - avg(v[i]) FILTER (grade = 0) AS d FROM v_pairs, range(1, 65) r(i) WHERE split = 'train' GROUP BY ALL) GROUP BY ALL)"
_OVR = f"SELECT axis, g AS grade, {_UNIT} AS w FROM (SELECT axis, g, list(d ORDER BY i) AS m FROM (SELECT axis, CAST(g AS INTEGER) AS g, i, avg(v[i]) FILTER (grade = g) - avg(v[i]) FILTER (grade <> g) AS d FROM v_pairs, range(1, 65) r(i), range(3) s(g) WHERE split = 'train' GROUP BY ALL) GROUP BY ALL)"
_ROWS = "CAST(i - 1 AS INTEGER) AS place, round(w[i], 6) AS x"
_C = ", ".join(f"count(*) FILTER (grade = {i} AND pred = {j}) AS c{i}{j}" for i in range(3) for j in range(3))
_F1 = " + ".join(
    f"coalesce(2.0::DOUBLE * c{g}{g} / nullif({' + '.join(f'c{g}{j} + c{j}{g}' for j in range(3))}, 0), 0)"
    for g in range(3)
)
_N = " + ".join(f"c{i}{j}" for i in range(3) for j in range(3))
_SEEN = " + ".join(f"{(i - j) ** 2} * c{i}{j}" for i in range(3) for j in range(3) if i != j)
_CHANCE = " + ".join(
    f"{(i - j) ** 2} * (c{i}0 + c{i}1 + c{i}2) * (c0{j} + c1{j} + c2{j})" for i in range(3) for j in range(3) if i != j
)

#: For each topic the cosine of its direction with the probe's.
_ALONG = """
        SELECT t.axis, abs(list_dot_product(d, w) / (sqrt(list_dot_product(d, d)) * sqrt(list_dot_product(w, w)))) AS c FROM (
          SELECT t.axis, cluster, list(t.m - g.m ORDER BY t.i) AS d FROM (
            SELECT axis, cluster, i, avg(v[i]) AS m FROM (SELECT *, count(*) FILTER (grade = 0) OVER (PARTITION BY axis, cluster) AS n0, count(*) OVER (PARTITION BY axis, cluster) AS n FROM v_pairs WHERE split = 'train'), range(1, 65) r(i)
            WHERE (n0 >= 3 AND grade = 0) OR (n0 < 3 AND n >= 5) GROUP BY ALL) t
          JOIN (SELECT axis, i, avg(v[i]) AS m FROM v_pairs, range(1, 65) r(i) WHERE split = 'train' GROUP BY ALL) g ON g.axis = t.axis AND g.i = t.i GROUP BY t.axis, cluster) t JOIN paired USING (axis)"""


def _selectivity_sql() -> str:
    """The probe's chain of views over every permutation of the training grades, as cells of their own."""
    renamed = {n: f"s_{n}" for n in ("scored", "cuts", "tuned", "classified")}

    def over(body: str) -> str:
        body = re.sub(r"\bv_pairs\b", "s_pairs", body)
        for old, new in {**renamed, "paired": "s_direction"}.items():
            body = re.sub(rf"\b{old}\b", new, body)
        return body

    views_ = {
        "s_pairs": """
            SELECT axis || '#0' AS axis, text_id, v, grade, cluster, split FROM v_pairs UNION ALL
            SELECT p.axis || '#' || p.s, p.text_id, p.v, coalesce(g.grade, p.grade), p.cluster, p.split
            FROM (SELECT *, row_number() OVER (PARTITION BY axis, s, split ORDER BY text_id) AS k FROM v_pairs, range(1, 6) r(s)) p
            LEFT JOIN (SELECT axis, s, grade, row_number() OVER (PARTITION BY axis, s ORDER BY sha256(s || ':' || text_id), text_id) AS k FROM v_pairs, range(1, 6) r(s) WHERE split = 'train') g
            ON g.axis = p.axis AND g.s = p.s AND g.k = p.k AND p.split = 'train'""",
        "s_direction": over(_EXTREME),
        **{new: over(views.SQL[old][0]) for old, new in renamed.items()},
    }
    chain = "".join(f",\n{name} AS MATERIALIZED ({body})" for name, body in views_.items())
    query = f"""SELECT axis, round(real_f1, 6) AS real_f1, round(mean_f1, 6) AS mean_f1, round(std_f1, 6) AS std_f1, round(real_f1 - mean_f1, 6) AS gap
        FROM (SELECT split_part(axis, '#', 1) AS axis, max(f1) FILTER (axis LIKE '%#0') AS real_f1, avg(f1) FILTER (axis NOT LIKE '%#0') AS mean_f1, stddev_pop(f1) FILTER (axis NOT LIKE '%#0') AS std_f1
          FROM (SELECT axis, ({_F1}) / 3 AS f1 FROM (SELECT axis, {_C} FROM s_classified GROUP BY axis)) GROUP BY 1)"""
    return with_views("", "v_pairs").rstrip("\n") + chain + "\n" + query


ORACLE = {
    "pair_paths": with_views("SELECT axis, path, count(*) AS n FROM matched GROUP BY ALL", "matched"),
    "paired_dom": with_views(f"SELECT axis, {_ROWS} FROM paired, range(1, 65) r(i)", "paired"),
    "extreme_dom": with_views(f"SELECT axis, {_ROWS} FROM ({_EXTREME}), range(1, 65) r(i)", "v_pairs"),
    "ovr_dom": with_views(f"SELECT axis, grade, {_ROWS} FROM ({_OVR}), range(1, 65) r(i)", "v_pairs"),
    "ovr_predictions": with_views(
        f"SELECT text_id, axis, g AS ovr_pred FROM (SELECT text_id, p.axis, o.grade AS g, row_number() OVER (PARTITION BY text_id ORDER BY round(list_dot_product(v, w), 9) DESC, o.grade) AS k FROM v_pairs p JOIN ({_OVR}) o ON o.axis = p.axis WHERE split = 'test') WHERE k = 1",
        "v_pairs",
    ),
    "projection": with_views("SELECT text_id, axis, round(score, 6) AS score FROM scored", "scored"),
    "threshold_tune": with_views(
        "SELECT axis, round(t1, 6) AS t1, round(t2, 6) AS t2, round(f1, 6) AS f1 FROM tuned", "tuned"
    ),
    "probe_eval": with_views(f"""SELECT axis, n_train, n_test, round(t1, 6) AS t1, round(t2, 6) AS t2, round(({_F1}) / 3, 6) AS macro_f1, round(1 - CAST({_SEEN} AS DOUBLE) * ({_N}) / nullif({_CHANCE}, 0), 6) AS qwk, round(CAST(c00 + c11 + c22 AS DOUBLE) / ({_N}), 6) AS agreement
        FROM (SELECT axis, {_C} FROM classified GROUP BY axis) JOIN tuned USING (axis) JOIN (SELECT axis, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM v_pairs GROUP BY axis) USING (axis)""", "classified", "tuned", "v_pairs"),
    "grade1_landing": with_views(
        "SELECT axis, count(*) FILTER (pred = 0) AS to_0, count(*) FILTER (pred = 1) AS to_1, count(*) FILTER (pred = 2) AS to_2 FROM classified WHERE grade = 1 GROUP BY axis",
        "classified",
    ),
    "direction_cosines": with_views(
        "SELECT a.axis AS a, b.axis AS b, round(list_dot_product(a.w, b.w) / (sqrt(list_dot_product(a.w, a.w)) * sqrt(list_dot_product(b.w, b.w))), 6) AS cosine FROM paired a JOIN paired b ON a.axis < b.axis",
        "paired",
    ),
    "residualize": with_views(
        f"SELECT axis, {_ROWS} FROM (SELECT axis, {_UNIT} AS w FROM (SELECT p.axis, [p.w[i] - list_dot_product(p.w, u.w) * u.w[i] for i in range(1, 65)] AS m FROM paired p, paired u WHERE u.axis = 'MU' AND p.axis <> 'MU')), range(1, 65) r(i)",
        "paired",
    ),
    "coverage": with_views(
        "SELECT round(avg(CAST(t.text_id IS NOT NULL AS DOUBLE)), 6) AS coverage, count(*) AS n FROM v_picks LEFT JOIN (SELECT DISTINCT text_id FROM v_pairs) t ON t.text_id = CAST(query_key AS BIGINT)",
        "v_picks",
        "v_pairs",
    ),
    "concatenated_vectors": with_views(
        "SELECT text_id, 192 AS dim, round(3 * list_dot_product(v, v), 5) AS squared FROM v_pairs WHERE text_id % 6 = 0",
        "v_pairs",
    ),
    "results_upsert": with_views(
        "SELECT axis, split, CASE WHEN split = 'dev' THEN -n ELSE n END AS n FROM (SELECT axis, split, count(*) AS n FROM v_pairs GROUP BY ALL)",
        "v_pairs",
    ),
    "topic_orthogonality": with_views(f"SELECT axis, count(*) AS n_topics, round(avg(c), 6) AS mean_abs, round(quantile_cont(c, 0.95), 6) AS p95_abs, round(max(c), 6) AS max_abs FROM ({_ALONG}) GROUP BY axis", "v_pairs", "paired"),
    "ordinality": with_views(
        "SELECT axis, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, m0 < m1 AND m1 < m2 AS monotone FROM (SELECT axis, avg(score) FILTER (grade = 0) AS m0, avg(score) FILTER (grade = 1) AS m1, avg(score) FILTER (grade = 2) AS m2 FROM scored WHERE split = 'test' GROUP BY axis)",
        "scored",
    ),
    "ordinal_gap": with_views(
        f"""SELECT axis, round(f1_ordinal, 6) AS f1_ordinal, round(f1_nominal, 6) AS f1_nominal, round(f1_nominal - f1_ordinal, 6) AS gap
        FROM (SELECT axis, ({_F1}) / 3 AS f1_ordinal FROM (SELECT axis, {_C} FROM classified GROUP BY axis))
        JOIN (SELECT axis, ({_F1}) / 3 AS f1_nominal FROM (SELECT axis, {_C} FROM (SELECT text_id, p.axis, p.grade, o.grade AS pred, row_number() OVER (PARTITION BY text_id ORDER BY round(list_dot_product(v, w), 9) DESC, o.grade) AS k
          FROM v_pairs p JOIN ({_OVR}) o ON o.axis = p.axis WHERE split = 'test') WHERE k = 1 GROUP BY axis)) USING (axis)""",
        "v_pairs",
        "classified",
    ),
    "topic_verdict": with_views(
        f"""SELECT axis, round(mean_abs, 6) AS mean_abs, round(eta, 6) AS eta_squared, CASE WHEN eta > 0.5 OR mean_abs > 0.3 THEN 'entangled' WHEN mean_abs > 0.15 THEN 'mixed' ELSE 'separate' END AS verdict
        FROM (SELECT axis, avg(c) AS mean_abs FROM ({_ALONG}) GROUP BY axis)
        JOIN (SELECT axis, sum(n * (m - g) * (m - g)) / (any_value(tot) + 1e-12) AS eta FROM (SELECT axis, cluster, count(*) AS n, avg(score) AS m FROM scored WHERE split = 'train' GROUP BY ALL)
          JOIN (SELECT axis, avg(score) AS g, var_pop(score) * count(*) AS tot FROM scored WHERE split = 'train' GROUP BY axis) USING (axis) GROUP BY axis) USING (axis)""",
        "v_pairs",
        "paired",
        "scored",
    ),
    "selectivity": _selectivity_sql(),
    "counterfactual": with_views("""SELECT axis, count(*) AS n, round(avg(p), 6) AS invariance, round((coalesce(sum(abs(u)), 0) + coalesce(sum(abs(d)), 0)) / nullif(count(u) + count(d), 0), 6) AS sensitivity,
          round(CAST(count(*) FILTER (u > 0) + count(*) FILTER (d > 0) AS DOUBLE) / nullif(count(u) + count(d), 0), 6) AS direction_correct,
          round((coalesce(sum(abs(u)), 0) + coalesce(sum(abs(d)), 0)) / nullif(count(u) + count(d), 0) / avg(p), 6) AS ratio
        FROM (SELECT e.axis, abs((p.score - s.score) / sd) AS p, (u.score - s.score) / sd AS u, -(d.score - s.score) / sd AS d
          FROM v_edits e JOIN scored s ON s.text_id = e.seed AND s.axis = e.axis LEFT JOIN scored p ON p.text_id = e.paraphrase AND p.axis = e.axis LEFT JOIN scored u ON u.text_id = e.up AND u.axis = e.axis LEFT JOIN scored d ON d.text_id = e.down AND d.axis = e.axis
          JOIN (SELECT e.axis, stddev_pop(score) AS sd FROM v_edits e JOIN scored s ON s.text_id = e.seed AND s.axis = e.axis GROUP BY e.axis) z ON z.axis = e.axis) GROUP BY axis""", "v_edits", "scored"),
}
QUERIES = {f.__name__: f for f in (
    pair_paths, paired_dom, extreme_dom, ovr_dom, ovr_predictions, projection, threshold_tune, probe_eval, grade1_landing, direction_cosines, residualize, coverage, concatenated_vectors, results_upsert, topic_orthogonality, ordinality, selectivity, counterfactual,
    ordinal_gap, topic_verdict, linear_head, ordinal_head, mlp_head, whitened_head, score_head, concat_head, head_gaps,
)}
