"""Queries over ratings, predictions and call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import golden, reports
from sievelight.operators import metrics as mx
from sievelight.plans import views
from sievelight.plans.views import with_views
from sievelight.sources.storage import table

MODELS = {"probe": (0.001, 0.0), "judge": (0.0, 0.02), "triage": (0.03, 0.001)}


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raters(spark, sf_dir).withColumn("part", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))


def _metric(spark: SparkSession, sf_dir: str, name: str, column) -> DataFrame:
    return mx.confusion(
        _rated(spark, sf_dir), "rater_a", "rater_b", ["part"]
    ).select("part", F.round(column, 6).alias(name))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.confusion_long(_rated(spark, sf_dir), "rater_a", "rater_b", ["part"])


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "macro_f1", mx.macro_f1_of())


def f1_per_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.confusion(_rated(spark, sf_dir), "rater_a", "rater_b", ["part"]).select(
        "part", *(F.round(mx.f1_of(g), 6).alias(f"f1_{g}") for g in mx.GRADES)
    )


def qwk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "qwk", mx.qwk_of())


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "kappa", mx.kappa_of())


def raw_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "agreement", mx.agreement_of())


def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.krippendorff_alpha(
        views.ratings(spark, sf_dir), "doc_id", "value"
    ).select(F.round("alpha", 6).alias("alpha"))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rated(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return mx.spearman(rows, "rater_a", "n_chars", ["part"]).withColumn("spearman", F.round("spearman", 6))


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rated(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    one = mx.auroc(
        rows, "n_chars", F.col("rater_a") >= 1, ["part"]
    ).select("part", F.round("auroc", 6).alias("auroc_1"))
    two = mx.auroc(
        rows, "n_chars", F.col("rater_a") >= 2, ["part"]
    ).select("part", F.round("auroc", 6).alias("auroc_2"))
    return one.join(two, "part")


def bootstrap_qwk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.bootstrap_qwk(_rated(spark, sf_dir), "rater_a", "rater_b", "doc_id")
    return out.select("n_used", *(F.round(c, 6).alias(c) for c in ("low", "median", "high")))


def bootstrap_qwk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval by draws of the confusion matrix, which cost the same for any number of rows."""
    return mx.bootstrap_qwk_counts(_rated(spark, sf_dir), "rater_a", "rater_b", by=["part"])


def pareto_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and score of systems, here call types, and whether they lie on the front."""
    points = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("kind")).agg(
        F.round(F.avg("value"), 6).alias("cost"), (F.count(F.lit(1)) % 97).alias("score")
    )
    return reports.pareto(points, "cost", "score")


def mode_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of each axis, here languages, against a baseline mode and a ceiling."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("axis"), F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")).alias("mode"), "n_chars"
    )
    cells = docs.groupBy("axis", "mode").agg(F.avg("n_chars").alias("a"), F.count(F.lit(1)).alias("n"))
    heads = cells.select("axis", "mode", F.explode(F.array(
        F.struct(F.lit("dom").alias("head"), F.round(F.col("a") / 10000, 6).alias("qwk"), F.round(F.col("a") / 10000 - 3 / F.col("n"), 6).alias("qwk_lo")),
        F.struct(F.lit("linear").alias("head"), F.round(F.col("n") / 200, 6).alias("qwk"), F.lit(None).cast("double").alias("qwk_lo")),
    )).alias("h")).select("axis", "mode", "h.*")
    ceiling = docs.groupBy("axis").agg(F.round(F.avg("n_chars") / 8000, 6).alias("human_qwk"))
    return reports.mode_verdict(heads, ceiling, "m0", ("m1", "m2"))


def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.eta_squared(
        table(spark, sf_dir, "documents"), "n_chars", "source", ["lang"]
    ).withColumn("eta_squared", F.round("eta_squared", 6))


def disagreement_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way raters disagree, and their kappa before and after grades 1 and 2 are one."""
    rows = _rated(spark, sf_dir)
    way = rows.groupBy("part").agg(
        F.count_if(F.col("rater_b") > F.col("rater_a")).alias("n_up"),
        F.count_if(F.col("rater_b") < F.col("rater_a")).alias("n_down"),
        F.round(F.avg((F.col("rater_a") >= 1).cast("double")), 6).alias("share_1"),
    )
    joined = rows.withColumns({c: F.least(F.col(c), F.lit(1)) for c in ("rater_a", "rater_b")})
    after = mx.confusion(joined, "rater_a", "rater_b", ["part"]).select(
        "part", F.round(mx.qwk_of(), 6).alias("qwk_after")
    )
    return way.join(after, "part")


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.latency(views.calls(spark, sf_dir), by=["concurrency"])
    return out.select("concurrency", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "least", "most")))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = views.calls(spark, sf_dir)
    return calls.groupBy("concurrency").agg(
        F.count("latency_s").alias("n_ok"),
        F.count(F.lit(1)).alias("n"),
        F.round(
            F.count("latency_s") / (F.sum("latency_s") / F.greatest(F.first("concurrency"), F.lit(1))), 6
        ).alias("qps"),
    )


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.histogram(table(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("x")), "x")


def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.box_stats(
        table(spark, sf_dir, "documents").withColumn("x", F.col("n_chars").cast("double")), "x", ["lang"]
    )


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")).alias("mode"), F.col("lang").alias("axis"), "n_chars"
    )
    return docs.groupBy("axis", "mode").agg(F.round(F.avg("n_chars") / 10000, 6).alias("qwk"))


def best_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.best_cell(_cells(spark, sf_dir), ["axis"], "qwk", "mode")


def mode_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.mode_delta(_cells(spark, sf_dir), ["axis"], "mode", "m0", "qwk").withColumn("delta", F.round("delta", 6))


def cell_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("axis").pivot("mode", ["m0", "m1", "m2", "m3"]).agg(F.max("qwk"))


def missed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.missed(_rated(spark, sf_dir), "rater_a", "rater_b", ["part"])


def error_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rated(spark, sf_dir).withColumn("other", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("rater_b")))
    return mx.caught_by_other(
        rows.withColumn("pred", F.col("rater_b")), rows.withColumn("pred", F.col("other")), "doc_id", "rater_a", "pred"
    )


def cost_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judging each source's documents costs."""
    return mx.cost_curves(table(spark, sf_dir, "documents"), MODELS, ["source"]).withColumn("cost", F.round("cost", 6))


def gold_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.resolved(views.ratings(spark, sf_dir), "doc_id", "value", "gold_adj")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_resolve(spark, sf_dir).groupBy("provenance").agg(F.count(F.lit(1)).alias("n"))


_C = ", ".join(f"count(*) FILTER (rater_a = {i} AND rater_b = {j}) AS c{i}{j}" for i in range(3) for j in range(3))
_CONF = f"SELECT part, {_C} FROM rated GROUP BY part"
_N = " + ".join(f"c{i}{j}" for i in range(3) for j in range(3))
_SEEN = " + ".join(f"{(i - j) ** 2} * c{i}{j}" for i in range(3) for j in range(3) if i != j)
_CHANCE = " + ".join(
    f"{(i - j) ** 2} * (c{i}0 + c{i}1 + c{i}2) * (c0{j} + c1{j} + c2{j})" for i in range(3) for j in range(3) if i != j
)
_QWK = f"1 - CAST({_SEEN} AS DOUBLE) * ({_N}) / nullif({_CHANCE}, 0)"
_F1 = [
    f"coalesce(2.0::DOUBLE * c{g}{g} / nullif({' + '.join(f'c{g}{j} + c{j}{g}' for j in range(3))}, 0), 0)"
    for g in range(3)
]
_PE = " + ".join(f"(c{i}0 + c{i}1 + c{i}2) * (c0{i} + c1{i} + c2{i})" for i in range(3))


def _sql(query: str, *names: str) -> str:
    body = with_views(query, *(names or ("v_raters",)))
    return body.replace(
        "\nSELECT",
        ",\nrated AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS part FROM v_raters)\nSELECT",
        1,
    ) if query.startswith("SELECT") else body


_RANKED = "SELECT part, rater_a, rank() OVER (PARTITION BY part ORDER BY rater_a) + (count(*) OVER (PARTITION BY part, rater_a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY part ORDER BY n_chars) + (count(*) OVER (PARTITION BY part, n_chars) - 1) / 2.0 AS rc FROM rated JOIN documents USING (doc_id)"
_AUC = "round(CAST(sum(rc) FILTER (rater_a >= {0}) - count(*) FILTER (rater_a >= {0}) * (count(*) FILTER (rater_a >= {0}) + 1) / 2.0 AS DOUBLE) / nullif(count(*) FILTER (rater_a >= {0}) * count(*) FILTER (rater_a < {0}), 0), 6) AS auroc_{0}"
_CELLS = "SELECT lang AS axis, 'm' || CAST(doc_id % 4 AS VARCHAR) AS mode, round(avg(n_chars) / 10000, 6) AS qwk FROM documents GROUP BY ALL"

ORACLE = {
    "confusion_matrix": _sql(
        "SELECT p.part, CAST(i AS INTEGER) AS true, CAST(j AS INTEGER) AS pred, count(r.doc_id) AS n FROM (SELECT DISTINCT part FROM rated) p CROSS JOIN range(3) a(i) CROSS JOIN range(3) b(j) LEFT JOIN rated r ON r.part = p.part AND rater_a = i AND rater_b = j GROUP BY ALL"
    ),
    "macro_f1": _sql(f"SELECT part, round(({' + '.join(_F1)}) / 3, 6) AS macro_f1 FROM ({_CONF})"),
    "f1_per_grade": _sql(
        "SELECT part, " + ", ".join(f"round({f}, 6) AS f1_{g}" for g, f in enumerate(_F1)) + f" FROM ({_CONF})"
    ),
    "qwk": _sql(f"SELECT part, round({_QWK}, 6) AS qwk FROM ({_CONF})"),
    "cohen_kappa": _sql(
        f"SELECT part, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM (SELECT part, CAST(c00 + c11 + c22 AS DOUBLE) / ({_N}) AS po, CAST({_PE} AS DOUBLE) / (({_N}) * ({_N})) AS pe FROM ({_CONF}))"
    ),
    "raw_agreement": _sql(
        "SELECT part, round(avg(CAST(rater_a = rater_b AS DOUBLE)), 6) AS agreement FROM rated GROUP BY part"
    ),
    "krippendorff_alpha": with_views(
        """SELECT round(1 - (SELECT sum(d) FROM (SELECT 2.0::DOUBLE * (rater_a - rater_b) * (rater_a - rater_b) AS d FROM v_raters)) / ((SELECT CAST(sum((a.value - b.value) * (a.value - b.value) * a.n * b.n) AS DOUBLE) FROM h a, h b) / ((SELECT sum(n) FROM h) - 1)), 6) AS alpha""",
        "v_raters",
    ).replace(
        "\nSELECT round",
        ",\nh AS (SELECT value, count(*) AS n FROM (SELECT rater_a AS value FROM v_raters UNION ALL SELECT rater_b FROM v_raters) GROUP BY 1)\nSELECT round",
    ),
    "spearman": _sql(f"SELECT part, round(corr(ra, rc), 6) AS spearman FROM ({_RANKED}) GROUP BY part"),
    "auroc": _sql(f"SELECT part, {_AUC.format(1)}, {_AUC.format(2)} FROM ({_RANKED}) GROUP BY part"),
    "bootstrap_qwk": _sql(f"""SELECT count(k) AS n_used, round(quantile_cont(k, 0.025), 6) AS low, round(quantile_cont(k, 0.5), 6) AS median, round(quantile_cont(k, 0.975), 6) AS high FROM (SELECT {_QWK} AS k FROM (SELECT b AS part, {_C} FROM (
        SELECT b, rater_a, rater_b FROM (SELECT b, CAST('0x' || substr(md5(CAST(b AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % (SELECT count(*) FROM rated) AS pos FROM range(1000) x(b), range((SELECT count(*) FROM rated)) y(i)) d JOIN (SELECT rater_a, rater_b, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM rated) USING (pos)) GROUP BY b)
        WHERE CAST(c00 + c01 + c02 > 0 AS INTEGER) + CAST(c10 + c11 + c12 > 0 AS INTEGER) + CAST(c20 + c21 + c22 > 0 AS INTEGER) > 1)"""),
    "pareto_points": "SELECT event_type, kind, cost, score, NOT EXISTS (SELECT 1 FROM p q WHERE q.cost <= p.cost AND q.score >= p.score AND (q.cost < p.cost OR q.score > p.score)) AS on_front FROM p".replace(
        "SELECT event_type", "WITH p AS (SELECT event_type, user_id % 5 AS kind, round(avg(value), 6) AS cost, count(*) % 97 AS score FROM events GROUP BY ALL) SELECT event_type", 1
    ),
    "mode_verdict": """
        WITH c AS (SELECT lang AS axis, 'm' || CAST(doc_id % 4 AS VARCHAR) AS mode, round(avg(n_chars) / 10000, 6) AS dom, round(avg(n_chars) / 10000 - 3::DOUBLE / count(*), 6) AS lo, round(count(*) / 200::DOUBLE, 6) AS linear FROM documents GROUP BY ALL),
        h AS (SELECT lang AS axis, round(avg(n_chars) / 8000, 6) AS human_qwk FROM documents GROUP BY ALL)
        SELECT c.axis, c.mode, c.dom, c.linear, round(c.dom - b.dom, 3) AS dom_change, round(c.linear - b.linear, 3) AS linear_change, greatest(c.dom, c.linear) AS best, c.lo > 0 AS signal,
               greatest(c.dom, c.linear) >= b.dom - 0.05 AS works, greatest(c.dom, c.linear) >= human_qwk - 0.05 AS in_band, c.mode IN ('m1', 'm2') AND greatest(c.dom, c.linear) >= b.dom - 0.05 AS holds
        FROM c JOIN h USING (axis) JOIN c b ON b.axis = c.axis AND b.mode = 'm0'""",
    "eta_squared": "SELECT lang, round(sum(n * (m - g) * (m - g)) / (any_value(tot) + 1e-12), 6) AS eta_squared FROM (SELECT lang, source, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY ALL) JOIN (SELECT lang, avg(n_chars) AS g, var_pop(n_chars) * count(*) AS tot FROM documents GROUP BY lang) USING (lang) GROUP BY lang",
    "disagreement_recode": _sql(
        f"SELECT part, n_up, n_down, share_1, round({_QWK}, 6) AS qwk_after FROM (SELECT part, {_C} FROM (SELECT part, least(rater_a, 1) AS rater_a, least(rater_b, 1) AS rater_b FROM rated) GROUP BY part) JOIN (SELECT part, count(*) FILTER (rater_b > rater_a) AS n_up, count(*) FILTER (rater_b < rater_a) AS n_down, round(avg(CAST(rater_a >= 1 AS DOUBLE)), 6) AS share_1 FROM rated GROUP BY part) USING (part)"
    ),
    "latency_summary": with_views(
        "SELECT concurrency, count(*) AS n, round(avg(latency_s), 6) AS mean, round(quantile_cont(latency_s, 0.5), 6) AS median, round(quantile_cont(latency_s, 0.95), 6) AS p95, round(min(latency_s), 6) AS least, round(max(latency_s), 6) AS most FROM v_calls WHERE latency_s IS NOT NULL GROUP BY concurrency",
        "v_calls",
    ),
    "throughput": with_views(
        "SELECT concurrency, count(latency_s) AS n_ok, count(*) AS n, round(count(latency_s) / (sum(latency_s) / greatest(concurrency, 1)), 6) AS qps FROM v_calls GROUP BY concurrency",
        "v_calls",
    ),
    "score_histogram": "SELECT CAST(b AS INTEGER) AS bin, count(pos) AS n FROM range(31) r(b) LEFT JOIN (SELECT least(floor((n_chars - lo) / CAST(hi - lo AS DOUBLE) * 31), 30) AS pos FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)) ON pos = b GROUP BY b",
    "box_stats": "SELECT lang, CAST(min(n_chars) AS DOUBLE) AS least, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS median, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3, CAST(max(n_chars) AS DOUBLE) AS most, count(*) AS n FROM documents GROUP BY lang",
    "best_cell": f"SELECT axis, mode, qwk FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY qwk DESC, mode) AS k FROM ({_CELLS})) WHERE k = 1",
    "mode_delta": f"SELECT a.axis, a.mode, round(a.qwk - b.qwk, 6) AS delta, CASE WHEN a.qwk - b.qwk > 0.02 THEN 'better' WHEN a.qwk - b.qwk < -0.02 THEN 'worse' ELSE 'even' END AS verdict FROM ({_CELLS}) a JOIN ({_CELLS}) b ON b.axis = a.axis AND b.mode = 'm0' WHERE a.mode <> 'm0'",
    "cell_matrix": "SELECT axis, " + ", ".join(
        f"max(qwk) FILTER (mode = 'm{k}') AS m{k}" for k in range(4)
    ) + f" FROM ({_CELLS}) GROUP BY axis",
    "missed_top": _sql(
        "SELECT part, count(*) FILTER (rater_a = 2 AND rater_b = 0) AS n_missed, count(*) FILTER (rater_a = 2) AS n_true FROM rated GROUP BY part"
    ),
    "error_difference": _sql(
        "SELECT doc_id FROM rated WHERE rater_a = 2 AND (doc_id % 3 = 0 OR rater_b = 0) AND rater_b <> 0"
    ),
    "cost_curves": "SELECT source, CAST(n AS INTEGER) AS n_axes, model, round(rows * (fixed + each * n), 6)::DOUBLE AS cost FROM (SELECT source, count(*) AS rows FROM documents GROUP BY 1), range(1, 16) r(n), (VALUES ('probe', 0.001, 0.0), ('judge', 0.0, 0.02), ('triage', 0.03, 0.001)) m(model, fixed, each)",
    "gold_resolve": with_views(
        "SELECT doc_id, coalesce(gold_adj, CASE WHEN rater_a = rater_b THEN rater_a END) AS gold, CASE WHEN gold_adj IS NOT NULL THEN 'adjudicated' WHEN rater_a = rater_b THEN 'agreement' ELSE 'unresolved' END AS provenance FROM v_raters",
        "v_raters",
    ),
    "provenance": with_views(
        "SELECT CASE WHEN gold_adj IS NOT NULL THEN 'adjudicated' WHEN rater_a = rater_b THEN 'agreement' ELSE 'unresolved' END AS provenance, count(*) AS n FROM v_raters GROUP BY 1",
        "v_raters",
    ),
}
QUERIES = {f.__name__: f for f in (
    confusion_matrix, macro_f1, f1_per_grade, qwk, cohen_kappa, raw_agreement, krippendorff_alpha, spearman, auroc, bootstrap_qwk, bootstrap_qwk_counts, pareto_points, mode_verdict, eta_squared, disagreement_recode, latency_summary, throughput, score_histogram, box_stats, best_cell, mode_delta, cell_matrix,
    missed_top, error_difference, cost_curves, gold_resolve, provenance,
)}
