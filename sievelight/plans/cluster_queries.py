"""Queries over clusters of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import vectors as vx
from sievelight.operators import clusters as cl
from sievelight.operators import density, layout, linkage, reports
from sievelight.plans import views
from sievelight.plans.views import with_views
from sievelight.sources.storage import settled, table

STOPWORDS = ["the", "and", "of", "de", "la", "der", "die", "le", "les"]
THRESHOLDS = [0.05 * k for k in range(1, 25)]


def _flat(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("place", "x")).withColumn("x", F.round("x", 6))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(cl.centroids(views.clusters(spark, sf_dir)), ["cluster_id"], "centroid")


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.clusters(spark, sf_dir)
    return cl.nearest_centroid(points, cl.centroids(points), ["vec_id"]).withColumn("cosine", F.round("cosine", 6))


def noise_reassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.reassign_noise(views.clusters(spark, sf_dir), "vec_id")


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.exemplars(views.clusters(spark, sf_dir), "vec_id").withColumn("rank", F.col("rank").cast("long"))


def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.pairwise_distances(
        cl.centroids(views.clusters(spark, sf_dir))
    ).withColumn("distance", F.round("distance", 6))


def group_max_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = cl.centroids(views.clusters(spark, sf_dir)).withColumn("category", (F.col("cluster_id") % 2).cast("int"))
    pairs = cl.pairwise_distances(centres, within="category")
    return pairs.groupBy("category").agg(
        F.round(F.max("distance"), 6).alias("max_distance"), F.count(F.lit(1)).alias("n_pairs")
    )


def embedding_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").select(vx.norm(vx.doubles(F.col("embedding"))).alias("n"))
    return n.agg(
        F.round(F.min("n"), 5).alias("least"),
        F.round(F.max("n"), 5).alias("most"),
        F.round(F.avg("n"), 5).alias("mean"),
        F.count(F.lit(1)).alias("n"),
    )


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null and doc_id is not null")
    return cl.terms(docs, "source", "text", STOPWORDS, bigrams=False)


def ctfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.ctfidf(
        term_counts(spark, sf_dir), "source", 20, min_groups=2
    ).withColumn("rank", F.col("rank").cast("long"))


def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return cl.terms(docs, "lang", "text", STOPWORDS).filter("term like '% %'").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n")
    )


def cluster_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cl.overview_members(views.clusters(spark, sf_dir), limit=5)
    return out.withColumn("top_keys", F.array_join("top_keys", "|"))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.size_stats(views.clusters(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = views.clusters(spark, sf_dir).filter("cluster_id <> -1")
    labelled = points.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_queries"))
    labelled = labelled.select(
        "cluster_id",
        "n_queries",
        F.concat(F.lit("label"), F.col("cluster_id").cast("string")).alias("label"),
        F.when(F.col("cluster_id") < 5, "low").otherwise("high").alias("category"),
        (F.col("cluster_id") % 3).alias("merged"),
    )
    members = points.select("cluster_id", "query_key", F.upper("query_key").alias("query"), "clicks")
    return members, labelled


def supercluster_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.super_clusters(*_merged(spark, sf_dir)).select(
        "supercluster_id",
        "category",
        "merged",
        "n_queries",
        "label",
        F.array_join("constituents", ",").alias("constituents"),
    )


def supercluster_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.super_cluster_queries(*_merged(spark, sf_dir))


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.clusters(spark, sf_dir).withColumn(
        "cluster_id", F.when(F.col("cluster_id") == -1, -1).otherwise(F.col("cluster_id") * 3 + F.col("vec_id") % 3)
    )
    return cl.centroids(points).withColumn("category", F.when(F.col("cluster_id") % 2 == 0, "even").otherwise("odd"))


def upgma_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.merge_within(_categories(spark, sf_dir), "category").withColumn("cut", F.round("cut", 6))


def knee_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges up to each threshold, of neighbouring clusters as stand-in heights."""
    centres = cl.centroids(views.clusters(spark, sf_dir))
    heights = cl.pairwise_distances(centres).filter("b_id = a_id + 1").select(F.round("distance", 6).alias("height"))
    return cl.knee_table(heights, centres, THRESHOLDS)


def knee_of_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = _categories(spark, sf_dir)
    return cl.knee_table(linkage.merge_heights(centres, "category"), centres, THRESHOLDS)


def merge_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = linkage.merge_within(
        _categories(spark, sf_dir), "category"
    ).groupBy("category", "merged").agg(F.count(F.lit(1)).alias("n"))
    return merged.groupBy("category").agg(
        F.sum("n").alias("n_clusters"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("n") == 1).alias("n_single"),
        F.round(100.0 * (F.sum("n") - F.count(F.lit(1))) / F.sum("n"), 6).alias("reduction"),
    )


def merge_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two cutoffs make of the clusters, the second on the way from the first to the last merge."""
    centres = settled(_categories(spark, sf_dir))
    merges = linkage.linkage(centres, "category")
    return reports.two_levels(*(linkage.merge_at(centres, "category", h, merges=merges) for h in (0.2, 0.6)))


def reduced_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.neighbour_layout(views.clusters(spark, sf_dir), "vec_id")


def plane_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of five dimensions laid out anew in two."""
    five = settled(reduced_vectors(spark, sf_dir))
    return layout.neighbour_layout(five, "vec_id", 2, "reduced", min_dist=0.1, metric="euclidean")


def component_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.reduce_dimensions(views.clusters(spark, sf_dir), "vec_id")


def layout_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the layout; its noise is left as it is."""
    return density.density_clusters(reduced_vectors(spark, sf_dir), "vec_id", "reduced", metric="euclidean")


def density_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_clusters(views.clusters(spark, sf_dir), "vec_id")


_RECORDS = """labelled AS (SELECT cluster_id, count(*) AS n_queries, 'label' || CAST(cluster_id AS VARCHAR) AS label, CASE WHEN cluster_id < 5 THEN 'low' ELSE 'high' END AS category, cluster_id % 3 AS merged FROM v_clusters WHERE cluster_id <> -1 GROUP BY cluster_id),
  named AS (SELECT *, format('{}_{:04d}', category, row_number() OVER (PARTITION BY category ORDER BY n_queries DESC, first_id)) AS supercluster_id FROM (
    SELECT category, merged, CAST(sum(n_queries) AS BIGINT) AS n_queries, string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY cluster_id) AS constituents, min_by(label, (-n_queries, cluster_id)) AS label, min(cluster_id) AS first_id FROM labelled GROUP BY ALL))"""

ORACLE = {
    "centroids": with_views(
        "SELECT cluster_id, CAST(i - 1 AS INTEGER) AS place, round(centroid[i], 6) AS x FROM centres, range(1, 65) r(i)",
        "centres",
    ),
    "nearest_centroid": with_views(
        "SELECT vec_id, cluster_id, round(c, 6) AS cosine FROM (SELECT vec_id, c.cluster_id, list_dot_product(embedding, centroid) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(centroid, centroid))) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(embedding, centroid) DESC, c.cluster_id) AS k FROM v_clusters, centres c) WHERE k = 1",
        "centres",
    ),
    "noise_reassigned": with_views(
        "SELECT vec_id, cluster_id, false AS reassigned FROM v_clusters WHERE cluster_id <> -1 UNION ALL SELECT vec_id, cluster_id, true FROM (SELECT vec_id, c.cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(embedding, centroid) DESC, c.cluster_id) AS k FROM (SELECT * FROM v_clusters WHERE cluster_id = -1), centres c) WHERE k = 1",
        "centres",
    ),
    "exemplars": with_views(
        "SELECT cluster_id, vec_id, cosine, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cosine DESC, vec_id) AS k FROM (SELECT cluster_id, vec_id, round(list_dot_product(embedding, centroid) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(centroid, centroid))), 6) AS cosine FROM v_clusters JOIN centres USING (cluster_id))) WHERE k <= 10",
        "centres",
    ),
    "pairwise_cosine": with_views(
        "SELECT a.cluster_id AS a_id, b.cluster_id AS b_id, round(1 - list_dot_product(a.centroid, b.centroid) / (sqrt(list_dot_product(a.centroid, a.centroid)) * sqrt(list_dot_product(b.centroid, b.centroid))), 6) AS distance FROM centres a JOIN centres b ON a.cluster_id < b.cluster_id",
        "centres",
    ),
    "group_max_distance": with_views(
        "SELECT a.cluster_id % 2 AS category, round(max(1 - list_dot_product(a.centroid, b.centroid)), 6) AS max_distance, count(*) AS n_pairs FROM centres a JOIN centres b ON a.cluster_id < b.cluster_id AND a.cluster_id % 2 = b.cluster_id % 2 GROUP BY 1",
        "centres",
    ),
    "embedding_sanity": "SELECT round(min(n), 5) AS least, round(max(n), 5) AS most, round(avg(n), 5) AS mean, count(*) AS n FROM (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)",
    "term_counts": r"SELECT source, term, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}')) AS term FROM documents WHERE text IS NOT NULL) WHERE term NOT IN ('the', 'and', 'of', 'de', 'la', 'der', 'die', 'le', 'les') GROUP BY ALL",
    "ctfidf_top": r"""WITH t AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}')) AS term FROM documents WHERE text IS NOT NULL) WHERE term NOT IN ('the', 'and', 'of', 'de', 'la', 'der', 'die', 'le', 'les') GROUP BY ALL),
        k AS (SELECT source, t.term, n, f FROM t JOIN (SELECT term, sum(n) AS f FROM t GROUP BY 1 HAVING count(*) >= 2) USING (term)), s AS (SELECT source, sum(n) AS size FROM k GROUP BY 1)
        SELECT source, term, weight, rank FROM (SELECT source, term, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank FROM (SELECT source, term, round(CAST(n AS DOUBLE) / size * ln(1 + (SELECT avg(size) FROM s) / f), 6) AS weight FROM k JOIN s USING (source))) WHERE rank <= 20""",
    "bigram_counts": r"""SELECT lang, count(DISTINCT term) AS n_terms, count(*) AS n FROM (SELECT lang, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS term FROM (SELECT lang, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}'), lambda x: x NOT IN ('the', 'and', 'of', 'de', 'la', 'der', 'die', 'le', 'les')) AS w FROM documents WHERE text IS NOT NULL)) GROUP BY lang""",
    "cluster_overview": with_views(
        "SELECT cluster_id, v.query_key, size, total_clicks, top_keys FROM v_clusters v JOIN (SELECT cluster_id, count(*) AS size, CAST(sum(clicks) AS BIGINT) AS total_clicks, string_agg(query_key, '|' ORDER BY k) FILTER (k <= 5) AS top_keys FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY clicks DESC, query_key) AS k FROM v_clusters WHERE cluster_id <> -1) GROUP BY 1) o USING (cluster_id)",
        "v_clusters",
    ),
    "cluster_sizes": with_views(
        "SELECT count(*) FILTER (cluster_id <> -1) AS n_clusters, min(n) FILTER (cluster_id <> -1) AS least, quantile_cont(n::DOUBLE, 0.5) FILTER (cluster_id <> -1) AS median, max(n) FILTER (cluster_id <> -1) AS most, CAST(coalesce(sum(n) FILTER (cluster_id = -1), 0) AS BIGINT) AS n_noise FROM (SELECT cluster_id, count(*) AS n FROM v_clusters GROUP BY 1)",
        "v_clusters",
    ),
    "supercluster_records": with_views(
        "SELECT supercluster_id, category, merged, n_queries, label, constituents FROM named", "v_clusters"
    ).replace("\nSELECT supercluster_id", f",\n{_RECORDS}\nSELECT supercluster_id"),
    "supercluster_flat": with_views(
        "SELECT supercluster_id, label, query_key, upper(query_key) AS query, clicks, cluster_id FROM (SELECT n.supercluster_id, n.label, v.query_key, v.clicks, v.cluster_id, row_number() OVER (PARTITION BY n.supercluster_id ORDER BY v.clicks DESC, v.query_key) AS k FROM v_clusters v JOIN labelled l USING (cluster_id) JOIN named n ON n.category = l.category AND n.merged = l.merged)",
        "v_clusters",
    ).replace("\nSELECT supercluster_id", f",\n{_RECORDS}\nSELECT supercluster_id"),
    "knee_table": with_views("""SELECT threshold, count(height) AS n_merges, (SELECT count(*) FROM centres) - count(height) AS n_clusters, round(100.0::DOUBLE * count(height) / (SELECT count(*) FROM centres), 6) AS reduction
        FROM (SELECT 0.05::DOUBLE * k AS threshold FROM range(1, 25) r(k)) LEFT JOIN (SELECT round(1 - list_dot_product(a.centroid, b.centroid) / (sqrt(list_dot_product(a.centroid, a.centroid)) * sqrt(list_dot_product(b.centroid, b.centroid))), 6) AS height FROM centres a JOIN centres b ON b.cluster_id = a.cluster_id + 1) ON height <= threshold GROUP BY threshold""", "centres"),
}
QUERIES = {f.__name__: f for f in (
    centroids, nearest_centroid, noise_reassigned, exemplars, pairwise_cosine, group_max_distance, embedding_sanity, term_counts, ctfidf_top, bigram_counts, cluster_overview, cluster_sizes, supercluster_records, supercluster_flat, upgma_merge, knee_table,
    knee_of_merges, merge_breakdown, merge_levels, reduced_vectors, plane_vectors, component_vectors, density_cluster, layout_clusters,
)}
