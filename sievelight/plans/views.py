"""Views of the driver's tables in the shapes that the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.functions import vectors as vx
from sievelight.functions.hashing import split_of
from sievelight.sources.storage import table

SOURCES = ["site1_ga4", "site1_internal"]


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query log of the first words of documents."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    two = F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1)
    q = F.when((F.col("doc_id") % 2 == 1) & (two != ""), two).otherwise(F.regexp_extract("text", r"^\s*(\S+)", 1))
    rows = docs.withColumn("q", q)
    # No upper case for ß, which is SS in some engines and stays in others.
    query = F.when((F.col("doc_id") % 3 == 1) & ~F.contains("q", F.lit("ß")), F.upper("q")).when(
        F.col("doc_id") % 3 == 2, tx.strip_marks(F.col("q"))
    ).otherwise(F.col("q"))
    ga4 = F.col("doc_id") % 2 == 0
    return rows.select(
        "doc_id", query.alias("query"), tx.fold(query).alias("query_key"), F.when(
            ga4, SOURCES[0]
        ).otherwise(SOURCES[1]).alias("source"), F.col("source").alias("source_file"),
        (F.col("n_chars") % 50).alias("clicks"), F.col("n_chars").alias("impressions"), F.when(
            ga4, (F.col("n_chars") % 97) / 97.0
        ).alias("ctr"), "lang",
        F.date_add(
            F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")
        ).cast("string").alias("last_searched"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded vectors with clusters, pair keys and splits."""
    rows = table(spark, sf_dir, "embeddings").withColumns(
        {"grade": F.col("label") % 3, "cluster": F.concat(F.lit("sc_"), F.expr("(vec_id div 6) % 25").cast("string"))}
    )
    axis = F.when(F.col("vec_id") % 3 == 0, "MU").when(F.col("vec_id") % 3 == 1, "PU").otherwise("ET")
    return rows.select(
        axis.alias("axis"),
        F.col("vec_id").alias("text_id"),
        vx.doubles(F.col("embedding")).alias("v"),
        "grade",
        "cluster",
        F.col("vec_id").alias("query_key"),
        F.when(F.col("grade") == 2, F.col("vec_id") - 3).otherwise(F.col("vec_id")).alias("pair_key"),
        split_of(F.col("cluster")).alias("split"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        "vec_id",
        vx.doubles(F.col("embedding")).alias("embedding"),
        F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("label")).alias("cluster_id"),
        (F.col("vec_id") * 7 % 101).alias("clicks"),
        F.format_string("key%05d", "vec_id").alias("query_key"),
    )


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("rater_a", F.col("quality") + F.col("toxic"))
    other = F.when(F.col("doc_id") % 7 == 0, (F.col("rater_a") + 1) % 3).otherwise(F.col("rater_a"))
    return rows.select(
        "doc_id",
        "rater_a",
        other.alias("rater_b"),
        F.when(F.col("doc_id") % 14 == 0, F.col("rater_a")).alias("gold_adj"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raters(spark, sf_dir).select("doc_id", "gold_adj", F.explode(F.array("rater_a", "rater_b")).alias("value"))


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    token = lambda axis, two, one: F.when(d % two == 0, f"{axis}2").when(d % one == 0, f"{axis}1").otherwise(f"{axis}0")
    category = F.when(F.col("lang") == "en", "oncology-core").when(
        F.col("lang") == "de", "oncology-adjacent"
    ).when(F.col("lang") == "fr", "navigational").otherwise("non-clinical")
    return docs.select(
        d.cast("string").alias("query_key"), F.coalesce("text", F.lit("")).alias("query_text"), F.concat(
            "source", F.lit("_"), (d % 40).cast("string")
        ).alias("supercluster_id"),
        category.alias(
            "clinical_relevance"
        ), token(
            "MU", 11, 3
        ).alias("mu_grade"), token("PU", 13, 4).alias("pu_grade"), token("ET", 3, 2).alias("et_grade"),
        (1 + d % 5).cast("int").alias("mu_confidence"), F.expr(
            "cast(1 + (doc_id div 5) % 5 as int)"
        ).alias("pu_confidence"), F.expr(
            "cast(1 + (doc_id div 25) % 5 as int)"
        ).alias("et_confidence"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id"),
        (F.col("user_id") % 3).cast("int").alias("concurrency"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("latency_s"),
        F.when(F.col("user_id") % 3 == 0, "gpt-5.4").when(
            F.col("user_id") % 3 == 1, "gpt-5.4-mini"
        ).otherwise("other").alias("model"),
        (F.col("event_id") % 3000).alias("prompt_tokens"),
        (F.col("event_id") % 700).alias("completion_tokens"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.when(F.col("vec_id") % 3 == 0, "MU").when(F.col("vec_id") % 3 == 1, "PU").otherwise("ET").alias("axis"),
        F.col("vec_id").alias("seed"),
        (F.col("vec_id") + 3).alias("paraphrase"),
        (F.col("vec_id") + 6).alias("up"),
        (F.col("vec_id") + 9).alias("down"),
    )


_FOLD = r"trim(regexp_replace(strip_accents(lower({0})), '\s+', ' ', 'g'))"

#: Each view as the body of a common table expression, and the views that it needs.
SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_query_log": (
        rf"""
        SELECT doc_id, query, {_FOLD.format("query")} AS query_key, source, source_file, clicks, impressions, ctr, lang, last_searched FROM (
          SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN CASE WHEN strpos(q, 'ß') > 0 THEN q ELSE upper(q) END WHEN 2 THEN strip_accents(q) ELSE q END AS query,
                 CASE WHEN doc_id % 2 = 0 THEN 'site1_ga4' ELSE 'site1_internal' END AS source, source AS source_file,
                 n_chars % 50 AS clicks, n_chars AS impressions, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars % 97 AS DOUBLE) / 97 END AS ctr, lang,
                 CAST(CAST('2025-01-01' AS DATE) + CAST(doc_id % 300 AS INTEGER) AS VARCHAR) AS last_searched
          FROM (SELECT *, CASE WHEN doc_id % 2 = 1 AND regexp_extract(text, '^\s*(\S+\s+\S+)', 1) <> '' THEN regexp_extract(text, '^\s*(\S+\s+\S+)', 1)
                               ELSE regexp_extract(text, '^\s*(\S+)', 1) END AS q FROM documents WHERE text IS NOT NULL))""",
        (),
    ),
    "v_pairs": (
        """
        SELECT CASE vec_id % 3 WHEN 0 THEN 'MU' WHEN 1 THEN 'PU' ELSE 'ET' END AS axis, vec_id AS text_id, CAST(embedding AS DOUBLE[]) AS v, label % 3 AS grade, cluster,
               vec_id AS query_key, CASE WHEN label % 3 = 2 THEN vec_id - 3 ELSE vec_id END AS pair_key,
               CASE digits % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split
        FROM (SELECT *, list_sum([strpos('0123456789abcdef', c) - 1 for c in string_split(sha256(cluster), '')]) AS digits
              FROM (SELECT *, 'sc_' || CAST((vec_id // 6) % 25 AS VARCHAR) AS cluster FROM embeddings))""",
        (),
    ),
    "v_clusters": (
        "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS cluster_id, vec_id * 7 % 101 AS clicks, format('key{:05d}', vec_id) AS query_key FROM embeddings",
        (),
    ),
    "v_raters": (
        "SELECT doc_id, rater_a, CASE WHEN doc_id % 7 = 0 THEN (rater_a + 1) % 3 ELSE rater_a END AS rater_b, CASE WHEN doc_id % 14 = 0 THEN rater_a END AS gold_adj FROM (SELECT *, quality + toxic AS rater_a FROM labels)",
        (),
    ),
    "v_picks": (
        """
        SELECT CAST(doc_id AS VARCHAR) AS query_key, coalesce(text, '') AS query_text, source || '_' || CAST(doc_id % 40 AS VARCHAR) AS supercluster_id,
               CASE lang WHEN 'en' THEN 'oncology-core' WHEN 'de' THEN 'oncology-adjacent' WHEN 'fr' THEN 'navigational' ELSE 'non-clinical' END AS clinical_relevance,
               CASE WHEN doc_id % 11 = 0 THEN 'MU2' WHEN doc_id % 3 = 0 THEN 'MU1' ELSE 'MU0' END AS mu_grade,
               CASE WHEN doc_id % 13 = 0 THEN 'PU2' WHEN doc_id % 4 = 0 THEN 'PU1' ELSE 'PU0' END AS pu_grade,
               CASE WHEN doc_id % 3 = 0 THEN 'ET2' WHEN doc_id % 2 = 0 THEN 'ET1' ELSE 'ET0' END AS et_grade,
               CAST(1 + doc_id % 5 AS INTEGER) AS mu_confidence, CAST(1 + (doc_id // 5) % 5 AS INTEGER) AS pu_confidence, CAST(1 + (doc_id // 25) % 5 AS INTEGER) AS et_confidence
        FROM documents""",
        (),
    ),
    "v_calls": (
        "SELECT event_id, CAST(user_id % 3 AS INTEGER) AS concurrency, CASE WHEN event_id % 17 <> 0 THEN value END AS latency_s, CASE user_id % 3 WHEN 0 THEN 'gpt-5.4' WHEN 1 THEN 'gpt-5.4-mini' ELSE 'other' END AS model, event_id % 3000 AS prompt_tokens, event_id % 700 AS completion_tokens FROM events",
        (),
    ),
    "v_edits": (
        "SELECT CASE vec_id % 3 WHEN 0 THEN 'MU' WHEN 1 THEN 'PU' ELSE 'ET' END AS axis, vec_id AS seed, vec_id + 3 AS paraphrase, vec_id + 6 AS up, vec_id + 9 AS down FROM embeddings",
        (),
    ),
    # Directions, scores and thresholds of the probes.
    "zero_cluster": (
        "SELECT axis, cluster, list(m ORDER BY i) AS v FROM (SELECT axis, cluster, i, avg(v[i]) AS m FROM v_pairs, range(1, 65) r(i) WHERE split = 'train' AND grade = 0 GROUP BY ALL) GROUP BY ALL",
        ("v_pairs",),
    ),
    "zero_cell": (
        "SELECT axis, list(m ORDER BY i) AS v FROM (SELECT axis, i, avg(v[i]) AS m FROM v_pairs, range(1, 65) r(i) WHERE split = 'train' AND grade = 0 GROUP BY ALL) GROUP BY ALL",
        ("v_pairs",),
    ),
    "matched": (
        """
        SELECT t.axis, t.text_id, t.v AS a, coalesce(z.v, c.v, g.v) AS b, CASE WHEN z.v IS NOT NULL THEN 'anchor' WHEN c.v IS NOT NULL THEN 'cluster' ELSE 'cell' END AS path
        FROM (SELECT * FROM v_pairs WHERE split = 'train' AND grade = 2) t
        LEFT JOIN (SELECT * FROM v_pairs WHERE split = 'train' AND grade = 0) z ON z.axis = t.axis AND z.query_key = t.pair_key
        LEFT JOIN zero_cluster c ON c.axis = t.axis AND c.cluster = t.cluster JOIN zero_cell g ON g.axis = t.axis""",
        ("v_pairs", "zero_cluster", "zero_cell"),
    ),
    "paired": (
        "SELECT axis, [x / sqrt(list_dot_product(m, m)) for x in m] AS w FROM (SELECT axis, list(d ORDER BY i) AS m FROM (SELECT axis, i, avg(a[i] - b[i]) AS d FROM matched, range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL)",
        ("matched",),
    ),
    "scored": (
        "SELECT p.axis, text_id, grade, cluster, split, round(list_dot_product(v, w), 12) AS score FROM v_pairs p JOIN paired USING (axis)",
        ("v_pairs", "paired"),
    ),
    "cuts": (
        """
        SELECT axis, unnest(list_distinct([round(x, 12) for x in quantile_cont(score, [0.02 + 0.96 * k / 59 for k in range(60)])])) AS t FROM scored WHERE split = 'dev' GROUP BY axis""",
        ("scored",),
    ),
    "tuned": (
        """
        SELECT axis, t1, t2, f1 FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY f1 DESC, t1, t2) AS k FROM (
          SELECT axis, t1, t2, round((coalesce(2.0 * c00 / nullif(r0 + p0, 0), 0) + coalesce(2.0 * c11 / nullif(r1 + p1, 0), 0) + coalesce(2.0 * c22 / nullif(r2 + p2, 0), 0)) / 3, 9) AS f1
          FROM (SELECT axis, t1, t2, count(*) FILTER (grade = 0 AND p = 0) AS c00, count(*) FILTER (grade = 1 AND p = 1) AS c11, count(*) FILTER (grade = 2 AND p = 2) AS c22,
                       count(*) FILTER (grade = 0) AS r0, count(*) FILTER (grade = 1) AS r1, count(*) FILTER (grade = 2) AS r2,
                       count(*) FILTER (p = 0) AS p0, count(*) FILTER (p = 1) AS p1, count(*) FILTER (p = 2) AS p2
                FROM (SELECT s.axis, a.t AS t1, b.t AS t2, grade, CASE WHEN score >= b.t THEN 2 WHEN score >= a.t THEN 1 ELSE 0 END AS p
                      FROM scored s JOIN cuts a ON a.axis = s.axis JOIN cuts b ON b.axis = s.axis AND a.t < b.t WHERE s.split = 'dev') GROUP BY ALL))) WHERE k = 1""",
        ("scored", "cuts"),
    ),
    "classified": (
        "SELECT s.*, CASE WHEN score >= t2 THEN 2 WHEN score >= t1 THEN 1 ELSE 0 END AS pred FROM scored s JOIN tuned USING (axis) WHERE split = 'test'",
        ("scored", "tuned"),
    ),
    "centres": (
        "SELECT cluster_id, [x / sqrt(list_dot_product(m, m)) for x in m] AS centroid FROM (SELECT cluster_id, list(a ORDER BY i) AS m FROM (SELECT cluster_id, i, avg(embedding[i]) AS a FROM v_clusters, range(1, 65) r(i) WHERE cluster_id <> -1 GROUP BY ALL) GROUP BY ALL)",
        ("v_clusters",),
    ),
}


def with_views(query: str, *names: str) -> str:
    """The query after the views that it names and all that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in SQL[name][1]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n][0]})" for n in order) + "\n" + query
