"""Queries behind reports: matches, contingency, audits, benchmarks of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators import clusters as cl
from sievelight.operators import filters, golden, pairs, ranking, reports
from sievelight.plans import views
from sievelight.plans.golden_queries import agreement
from sievelight.plans.views import with_views
from sievelight.sources.storage import settled, table

SYSTEMS = ["echo", "flip", "zero"]


def member_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.query_log(spark, sf_dir)
    members = log.select(F.col("source_file").alias("supercluster_id"), "query", "query_key")
    # As in the log itself, no upper case for ß, which is SS in some engines and stays in others.
    shown = F.when((F.col("doc_id") % 3 == 0) & ~F.contains("query", F.lit("ß")), F.upper("query")).when(
        F.col("doc_id") % 3 == 1, F.concat("query", F.lit(" x"))
    )
    picks = log.select(
        "doc_id", F.col("source_file").alias("supercluster_id"), F.coalesce(shown, "query").alias("query_text")
    )
    return reports.matched_members(picks, members).select("doc_id", "matched_key", "verbatim_match")


def axis_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = views.picks(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    done = labels.select(F.col("doc_id").cast("string").alias("query_key"), F.lit("MU").alias("axis"))
    return reports.axis_jobs(picks, pairs.AXES, done)


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.contingency(views.pairs(spark, sf_dir), ["axis", "split"], "grade", [0, 1, 2])


def cluster_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.cluster_diversity(views.picks(spark, sf_dir))
    return found.select("query_key", F.round("diversity", 6).alias("diversity"))


def confidence_by_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = agreement(spark, sf_dir).select("query_key", "is_iaa_hard_candidate").join(
        views.picks(spark, sf_dir), "query_key"
    )
    found = reports.confidence_by_subset(joined, "is_iaa_hard_candidate", [f"{a}_confidence" for a in golden.AXES])
    return found.withColumn("mean_confidence", F.round("mean_confidence", 6))


def dominant_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dominant(table(spark, sf_dir, "documents"), ["source"], "lang")


def metric_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pairs(spark, sf_dir).withColumn("real", F.col("text_id") % 5 != 0)
    real = F.avg(F.when(F.col("real") & (F.col("grade") > 0), F.col("grade")))
    blocks = rows.groupBy("axis", "cluster").agg(real.alias("real_mean"), F.avg("grade").alias("all_mean"))
    return blocks.select(
        "axis", "cluster", F.round(reports.first_metric(F.col("real_mean"), F.col("all_mean")), 6).alias("mean")
    )


def anchor_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = settled(views.clusters(spark, sf_dir))
    phrases = points.select(F.col("vec_id").alias("phrase"), "embedding")
    assigned = cl.nearest_centroid(phrases, cl.centroids(points), ["phrase"]).withColumn("cosine", F.round("cosine", 6))
    words = points.filter("cluster_id <> -1").select(
        "cluster_id",
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("term"),
        (F.col("vec_id") % 13).alias("weight"),
    )
    return reports.anchor_audit(
        assigned, words, points.select("cluster_id", F.col("query_key").alias("query"), "clicks")
    )


def system_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = views.raters(spark, sf_dir)
    gold = golden.resolved(
        views.ratings(spark, sf_dir), "doc_id", "value", "gold_adj"
    ).withColumnRenamed("doc_id", "item")
    flip = F.when(
        F.col("doc_id") % 4 == 0, 2 - F.col("rater_b")
    ).when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("rater_b"))
    said = F.explode(
        F.array(
            F.struct(F.lit("echo").alias("system"), F.col("rater_b").alias("pred")),
            F.struct(F.lit("flip").alias("system"), flip.alias("pred")),
            F.struct(F.lit("zero").alias("system"), F.lit(0).alias("pred")),
        )
    )
    predictions = rated.select(F.col("doc_id").alias("item"), said.alias("s")).select("item", "s.*")
    out = reports.benchmark(predictions, gold, ["system"])
    return out.select(
        "system",
        "n",
        "n_missed",
        "n_true",
        *(F.round(c, 6).alias(c) for c in ("coverage", "macro_f1", "qwk", "agreement")),
    )


def generator_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    return reports.by_model(
        turns, ["conv_id"], "role", ["user", "assistant"], "text"
    )


def relevance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = views.picks(spark, sf_dir).groupBy("supercluster_id").agg(
        F.min(
            "clinical_relevance"
        ).alias("clinical_relevance"), F.count(F.lit(1)).alias("size"), F.sum("mu_confidence").alias("clicks")
    )
    return reports.relevance_audit(
        sized, "clinical_relevance", "size", "clicks"
    ).withColumn("share", F.round("share", 6))


def playground_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four items of each grade of an axis, with their grade tokens swapped and a prompt rendered."""
    long = pairs.axis_long(views.picks(spark, sf_dir), ["query_key"])
    swapped = F.when(
        F.col("grade_token") == "PU1", "PU2"
    ).when(F.col("grade_token") == "PU2", "PU1").otherwise(F.col("grade_token"))
    picked = ranking.stratified_sample(long, ["axis", "grade"], 4, 11, "query_key")
    prompt = tx.render("Judge {axis} of {key}.", axis=F.col("axis"), key=F.col("query_key"))
    return picked.select("axis", "query_key", swapped.alias("grade_token"), prompt.alias("prompt"))


def person_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(
        "doc_id", F.col("text").alias("t")
    )
    return docs.select("doc_id", filters.capitalised_names(F.col("t")).alias("person_like"))


def stripped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.when(F.col("doc_id") % 2 == 0, "golden-v1:").otherwise(""), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", reports.without_prefix(key, "golden-v1:").alias("key"))


_FOLD = r"trim(regexp_replace(strip_accents(lower({0})), '\s+', ' ', 'g'))"
_C = ", ".join(f"count(*) FILTER (gold = {i} AND pred = {j}) AS c{i}{j}" for i in range(3) for j in range(3))
_N = " + ".join(f"c{i}{j}" for i in range(3) for j in range(3))
_PAIRS = [(i, j) for i in range(3) for j in range(3) if i != j]
_SEEN = " + ".join(f"{(i - j) ** 2} * c{i}{j}" for i, j in _PAIRS)
_CHANCE = " + ".join(f"{(i - j) ** 2} * (c{i}0 + c{i}1 + c{i}2) * (c0{j} + c1{j} + c2{j})" for i, j in _PAIRS)
_F1 = " + ".join(
    f"coalesce(2.0::DOUBLE * c{g}{g} / nullif({' + '.join(f'c{g}{j} + c{j}{g}' for j in range(3))}, 0), 0)"
    for g in range(3)
)

ORACLE = {
    "member_matches": with_views(
        f"""SELECT p.doc_id, coalesce(e.k, n.k, p.f) AS matched_key, e.k IS NOT NULL AS verbatim_match
        FROM (SELECT *, {_FOLD.format("t")} AS f FROM (SELECT doc_id, source_file, CASE WHEN doc_id % 3 = 0 AND strpos(query, 'ß') = 0 THEN upper(query) WHEN doc_id % 3 = 1 THEN query || ' x' ELSE query END AS t FROM v_query_log)) p
        LEFT JOIN (SELECT source_file, query, min(query_key) AS k FROM v_query_log GROUP BY ALL) e ON e.source_file = p.source_file AND e.query = p.t
        LEFT JOIN (SELECT source_file, {_FOLD.format("query")} AS f, min(query_key) AS k FROM v_query_log GROUP BY ALL) n ON n.source_file = p.source_file AND n.f = p.f""",
        "v_query_log",
    ),
    "axis_jobs": with_views(
        "SELECT query_key, axis FROM v_picks, (SELECT unnest(['MU', 'PU', 'ET']) AS axis) WHERE NOT (axis = 'MU' AND CAST(query_key AS BIGINT) IN (SELECT doc_id FROM labels))",
        "v_picks",
    ),
    "contingency": with_views(
        "SELECT axis, split, " + ", ".join(
            f"count(*) FILTER (grade = {g}) AS n_{g}" for g in range(3)
        ) + " FROM v_pairs GROUP BY ALL",
        "v_pairs",
    ),
    "cluster_diversity": with_views(
        "SELECT query_key, round(1.0::DOUBLE / count(*) OVER (PARTITION BY supercluster_id), 6) AS diversity FROM v_picks", "v_picks"
    ),
    "confidence_by_agreement": with_views(
        """SELECT hard AS is_iaa_hard_candidate, round(avg((mu_confidence + pu_confidence + et_confidence) / 3.0::DOUBLE), 6) AS mean_confidence, count(*) AS n FROM (
          SELECT *, NOT ((k % 5 <> 0 OR mu_grade = 'MU0') AND (k % 6 <> 0 OR pu_grade = 'PU0') AND (k % 7 <> 0 OR et_grade = 'ET0'))
                 OR (mu_grade <> 'MU0' AND k % 7 = 0) OR (pu_grade <> 'PU0' AND k % 8 = 0) OR (et_grade <> 'ET0' AND k % 9 = 0) AS hard
          FROM (SELECT *, CAST(query_key AS BIGINT) AS k FROM v_picks)) GROUP BY hard""",
        "v_picks",
    ),
    "dominant_category": "SELECT source, min_by(lang, (-n, lang)) AS lang FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source",
    "metric_fallback": with_views(
        "SELECT axis, cluster, round(coalesce(avg(grade) FILTER (text_id % 5 <> 0 AND grade > 0), avg(grade)), 6) AS mean FROM v_pairs GROUP BY ALL",
        "v_pairs",
    ),
    "anchor_audit": with_views(
        """SELECT phrase, a.cluster_id, cosine, top_words, top_queries FROM (
          SELECT vec_id AS phrase, c.cluster_id, round(list_dot_product(embedding, centroid) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(centroid, centroid))), 6) AS cosine,
                 row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(embedding, centroid) DESC, c.cluster_id) AS k FROM v_clusters, centres c) a
        LEFT JOIN (SELECT cluster_id, string_agg(term, ', ' ORDER BY k) AS top_words FROM (SELECT cluster_id, 'w' || CAST(vec_id AS VARCHAR) AS term, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id % 13 DESC, 'w' || CAST(vec_id AS VARCHAR)) AS k FROM v_clusters WHERE cluster_id <> -1) WHERE k <= 3 GROUP BY 1) w ON w.cluster_id = a.cluster_id
        LEFT JOIN (SELECT cluster_id, string_agg(query_key, ', ' ORDER BY k) AS top_queries FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY clicks DESC, query_key) AS k FROM v_clusters) WHERE k <= 3 GROUP BY 1) q ON q.cluster_id = a.cluster_id
        WHERE a.k = 1""",
        "centres",
        "v_clusters",
    ),
    "system_benchmark": with_views(
        f"""SELECT system, n, n_missed, n_true, round(coverage, 6) AS coverage, round(({_F1}) / 3, 6) AS macro_f1, round(1 - CAST({_SEEN} AS DOUBLE) * ({_N}) / nullif({_CHANCE}, 0), 6) AS qwk, round(CAST(c00 + c11 + c22 AS DOUBLE) / ({_N}), 6) AS agreement
        FROM (SELECT system, count(pred) AS n, avg(CAST(pred IS NOT NULL AS DOUBLE)) AS coverage, count(*) FILTER (gold = 2 AND pred = 0) AS n_missed, count(*) FILTER (gold = 2) AS n_true, {_C}
          FROM (SELECT system, gold, CASE system WHEN 'echo' THEN rater_b WHEN 'zero' THEN 0 ELSE CASE WHEN doc_id % 4 = 0 THEN 2 - rater_b WHEN doc_id % 9 = 0 THEN NULL ELSE rater_b END END AS pred
            FROM (SELECT *, coalesce(gold_adj, CASE WHEN rater_a = rater_b THEN rater_a END) AS gold FROM v_raters), (SELECT unnest(['echo', 'flip', 'zero']) AS system) WHERE gold IS NOT NULL) GROUP BY system)""",
        "v_raters",
    ),
    "generator_comparison": "SELECT conv_id, min(text) FILTER (role = 'user') AS \"user\", min(text) FILTER (role = 'assistant') AS assistant, count(DISTINCT role) AS n_models FROM conversations WHERE role <> 'system' GROUP BY conv_id",
    "relevance_audit": with_views(
        "SELECT clinical_relevance, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_queries, CAST(sum(c) AS BIGINT) AS clicks, round(100.0::DOUBLE * sum(size) / (SELECT count(*) FROM v_picks), 6) AS share FROM (SELECT supercluster_id, min(clinical_relevance) AS clinical_relevance, count(*) AS size, sum(mu_confidence) AS c FROM v_picks GROUP BY 1) GROUP BY 1",
        "v_picks",
    ),
    "playground_set": with_views(
        """SELECT axis, query_key, CASE token WHEN 'PU1' THEN 'PU2' WHEN 'PU2' THEN 'PU1' ELSE token END AS grade_token, 'Judge ' || axis || ' of ' || query_key || '.' AS prompt FROM (
          SELECT query_key, upper(substr(name, 1, 2)) AS axis, token, row_number() OVER (PARTITION BY token ORDER BY sha256('11:' || query_key), query_key) AS k FROM (UNPIVOT v_picks ON mu_grade, pu_grade, et_grade INTO NAME name VALUE token)) WHERE k <= 4""",
        "v_picks",
    ),
    "person_like": r"SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}\p{M}_])\p{Lu}\p{Ll}+\s+\p{Lu}\p{Ll}+(?:$|[^\p{L}\p{N}\p{M}_])')) > 0 AS person_like FROM documents WHERE text IS NOT NULL",
    "stripped_keys": "SELECT doc_id, source AS key FROM documents",
}
QUERIES = {
    f.__name__: f
    for f in (
        member_matches, axis_jobs, contingency, cluster_diversity, confidence_by_agreement, dominant_category, metric_fallback, anchor_audit,
        system_benchmark, generator_comparison, relevance_audit, playground_set, person_like, stripped_keys,
    )
}
