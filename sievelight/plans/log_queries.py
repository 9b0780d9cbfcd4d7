"""Queries over the query log: unification, filters, hashing, sampling and exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import hashing as hx
from sievelight.functions import text as tx
from sievelight.operators import filters, golden, logs, ranking, sets
from sievelight.plans import views
from sievelight.plans.views import with_views
from sievelight.sources.readers import json_fields
from sievelight.sources.storage import table

FLAGS = ["drop_clicks", "drop_digits", "drop_shorthand", "drop_title", "drop_spam"]
_MEAN = "CASE WHEN coalesce(sum(clicks), 0) = 0 THEN avg(ctr) ELSE coalesce(sum(ctr * clicks), 0) / sum(clicks) END"
_KEY_NUMBER = "list_reduce([CAST('0x' || substr(sha256({0}), 8 * j + 1, 8) AS BIGINT) for j in range(8)], lambda acc, c: (acc * 296 + c) % 1000)"


def query_log_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.query_log(spark, sf_dir).withColumn("query", tx.clean_query(F.col("query"))).filter("query is not null")
    return logs.dedup(log, ["query_key", "source"]).withColumn("ctr", F.round("ctr", 6))


def aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.cross_source(views.query_log(spark, sf_dir), views.SOURCES)


def cross_source_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregated(spark, sf_dir).withColumn("ctr", F.round("ctr", 6))


def canonical_source_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = logs.canonical_files(
        views.query_log(spark, sf_dir), ["source"], "source_file", "last_searched", "last_searched", "clicks"
    )
    return best.select(
        "source", "source_file", F.col("start").alias("date_start"), F.col("end").alias("date_end"), "clicks"
    )


def source_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.pivot_sums(views.query_log(spark, sf_dir), ["query_key"], "source", views.SOURCES, "clicks", "clicks")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.log_flags(aggregated(spark, sf_dir), min_clicks=5)


def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("query_key", *FLAGS, "drop_any")


def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.funnel(flagged(spark, sf_dir), FLAGS)


def blocklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.query_log(spark, sf_dir)
    blocked = log.groupBy("query_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    return filters.not_listed(log, blocked, "query_key").select("doc_id", "query_key")


def natural_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", tx.is_natural(F.col("text")).alias("is_natural"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.query_log(spark, sf_dir)
    return log.select(
        "doc_id",
        tx.clean_query(F.col("query")).alias("cleaned"),
        tx.is_digits(F.col("query")).alias("digits"),
        tx.normalize_name(F.col("query_key")).alias("name"),
    )


def dates_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("d"))
    raw = F.concat(
        (F.col("d") % 35).cast("string"),
        F.lit(". "),
        (F.col("d") % 14).cast("string"),
        F.lit(". "),
        (2000 + F.col("d") % 30).cast("string"),
        F.lit(" 10:30"),
    )
    number = F.when(
        F.col("d") % 3 == 0, F.concat(F.col("d").cast("string"), F.lit(",3 %"))
    ).otherwise(F.concat(F.col("d").cast("string"), F.lit(".5")))
    head = F.concat(
        F.lit("# "),
        (20200101 + F.col("d") % 28).cast("string"),
        F.when(F.col("d") % 2 == 0, F.concat(F.lit("-"), (20210101 + F.col("d") % 28).cast("string"))).otherwise(""),
    )
    dates = tx.header_dates(head)
    out = ids.select(
        "doc_id",
        tx.day_month_year(raw).cast("string").alias("day"),
        tx.number(number).alias("number"),
        dates.alias("h"),
    )
    return out.select(
        "doc_id",
        "day",
        F.year("day").cast("int").alias("year"),
        "number",
        F.col("h.start").alias("date_start"),
        F.col("h.end").alias("date_end"),
        F.datediff("h.end", "h.start").alias("span"),
    )


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return sets.remaining(
        table(spark, sf_dir, "documents").select("doc_id", "source"), vectors, ["doc_id"]
    )


def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    patches = table(spark, sf_dir, "labels").filter("toxic = 1").select(
        "doc_id", F.lit("xx").alias("lang"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("reason")
    )
    return sets.patched(docs, patches, "doc_id", "lang")


def hash_bucket_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    fractions = {"en": 0.5, "de": 1.0, "fr": 0.0, "es": 0.25}
    return golden.by_fraction(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", fractions)


def cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "documents").select(hx.split_of(F.col("source")).alias("split"), "source")
    return split.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select(
        "doc_id",
        hx.text_id(F.col("text")).alias("text_id"),
        hx.sha256(F.col("text")).alias("sha256"),
        hx.source_key("golden-v1:", F.col("text")).alias("source_key"),
    )


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = views.calls(spark, sf_dir)
    return calls.groupBy("model").agg(
        F.round(F.sum(golden.cost(calls, F.col("event_id") % 2 == 0)), 6).alias("usd"), F.count(F.lit(1)).alias("n")
    )


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_fields(
        table(spark, sf_dir, "events"), "props", "k long", ["event_id"]
    ).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def exclusion_disjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = views.picks(spark, sf_dir).select("query_key", "supercluster_id")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("query_key"), "quality", "toxic"
    )
    golden_ = picks.join(labels.filter("toxic = 1"), "query_key")
    return sets.excluding(
        sets.excluding(picks, golden_.select("query_key"), ["query_key"]),
        golden_.filter("quality = 0").select("supercluster_id"),
        ["supercluster_id"],
    )


def union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, turns = table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "conversations").select("text")
    texts = sets.union_all(docs, turns, table(spark, sf_dir, "benchmark").select("text")).filter("text is not null")
    return texts.select(hx.text_id(F.col("text")).alias("text_id")).distinct()


def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        tx.render("Source {source}, language {lang}.", source=F.col("source"), lang=F.col("lang")).alias("prompt"),
        tx.instructed(F.col("source"), "Find it").alias("instructed"),
        tx.slug(F.concat("source", F.lit(" É x"))).alias("slug"),
    )


def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, 7, "doc_id")


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified_sample(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 2, 7, "doc_id"
    ).select("doc_id", "lang", "source", F.col("rank").cast("long").alias("rank"))


def sample_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_up(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 5, 60, 3, "doc_id")


def cap_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return ranking.head_per_group(docs, ["source"], 3, F.asc("doc_id")).withColumn("rank", F.col("rank").cast("long"))


def topn_distinct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.query_log(spark, sf_dir).withColumn("key", F.col("doc_id"))
    return ranking.top_distinct(
        log, "source_file", "query", 3, "clicks", "key"
    ).withColumn("rank", F.col("rank").cast("long"))


def joined_top_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.joined_top(
        views.query_log(spark, sf_dir), "source_file", "query", 3, " | ", F.desc("clicks"), F.asc("doc_id")
    )


def diversity_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return ranking.diversity_first(
        docs, "source", 30, "doc_id", F.desc("n_chars"), F.asc("doc_id")
    ).withColumn("cluster_rank", F.col("cluster_rank").cast("long"))


def lowest_to_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ranking.lowest_to_reserve(docs, 40, "doc_id", F.asc("n_chars"))


def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.query_log(spark, sf_dir).select("source", "query_key", "clicks", "doc_id")
    return log.orderBy(F.asc("source"), F.asc("query_key"), F.desc("clicks"), F.asc("doc_id"))


def numbered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return ranking.numbered(sources, "lang", F.desc("n"), F.asc("source"))


def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources")
    )
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.crossJoin(total).select(
        "lang", "n", "n_sources", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share")
    )


def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").filter("lang = 'en'").select("source")
    b = table(spark, sf_dir, "documents").filter("lang = 'fr'").select("source")
    return a.intersect(b)


def expected_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in which more than one language is found: what an invariant would report."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count_distinct("lang").alias("n_lang")
    ).filter("n_lang > 1")


def fuzzy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "supplier").select(F.lit("").alias("firstname"), F.col("s_name").alias("lastname"))
    asked = table(spark, sf_dir, "customer").select(F.regexp_replace("c_name", "Customer", "Suppliers").alias("query"))
    return filters.person_flags(asked, people)


_AGG = f"""SELECT query_key, min_by(query, (-clicks, query, source)) AS query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {_MEAN} AS ctr,
  string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, max(last_searched) AS last_searched,
  CAST(coalesce(sum(clicks) FILTER (source = 'site1_ga4'), 0) AS BIGINT) AS clicks_site1_ga4,
  CAST(coalesce(sum(clicks) FILTER (source = 'site1_internal'), 0) AS BIGINT) AS clicks_site1_internal FROM v_query_log GROUP BY query_key"""
_SQL_SPAM = tx.SPAM.replace("'", "''")
_SQL_FLAGS = f"""SELECT *, drop_clicks OR drop_digits OR drop_shorthand OR drop_title OR drop_spam AS drop_any FROM (
  SELECT query_key, clicks, coalesce(clicks, 0) < 5 AS drop_clicks, regexp_matches(trim(query), '^\\d{{3,}}$') AS drop_digits,
    length(query_key) <= 4 AND clicks_site1_ga4 = 0 AND clicks_site1_internal > 0 AS drop_shorthand,
    regexp_matches(query, '{tx.TITLE}', 'i') AS drop_title, regexp_matches(query, '{_SQL_SPAM}', 'i') AS drop_spam FROM ({_AGG}))"""

ORACLE = {
    "query_log_dedup": with_views(f"""SELECT query_key, source, min_by(query, (-clicks, query)) AS query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round({_MEAN}, 6) AS ctr, count(*) AS n_rows
        FROM v_query_log WHERE length(trim(query)) >= 3 AND NOT regexp_matches(trim(query), '^\\s*$|^\\{{.*\\}}$|^[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]{{0,3}}$') GROUP BY ALL""", "v_query_log"),
    "cross_source_agg": with_views(f"SELECT * REPLACE (round(ctr, 6) AS ctr) FROM ({_AGG})", "v_query_log"),
    "canonical_source_pick": with_views("""SELECT source, source_file, date_start, date_end, clicks FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY date_diff('day', CAST(date_start AS DATE), CAST(date_end AS DATE)) DESC, clicks DESC, source_file) AS k
        FROM (SELECT source, source_file, min(last_searched) AS date_start, max(last_searched) AS date_end, CAST(sum(clicks) AS BIGINT) AS clicks FROM v_query_log GROUP BY ALL)) WHERE k = 1""", "v_query_log"),
    "source_pivot": with_views(
        """SELECT query_key, CAST(coalesce(sum(clicks) FILTER (source = 'site1_ga4'), 0) AS BIGINT) AS clicks_site1_ga4, CAST(coalesce(sum(clicks) FILTER (source = 'site1_internal'), 0) AS BIGINT) AS clicks_site1_internal FROM v_query_log GROUP BY ALL""",
        "v_query_log",
    ),
    "filter_flags": with_views(
        f"SELECT query_key, drop_clicks, drop_digits, drop_shorthand, drop_title, drop_spam, drop_any FROM ({_SQL_FLAGS})",
        "v_query_log",
    ),
    "filter_funnel": with_views(f"""SELECT rule, count(*) FILTER (flag) AS n_rows, CAST(coalesce(sum(clicks) FILTER (flag), 0) AS BIGINT) AS clicks FROM (
        SELECT unnest(['drop_clicks', 'drop_digits', 'drop_shorthand', 'drop_title', 'drop_spam', 'kept']) AS rule, unnest([drop_clicks, drop_digits, drop_shorthand, drop_title, drop_spam, NOT drop_any]) AS flag, clicks FROM ({_SQL_FLAGS})) GROUP BY rule""", "v_query_log"),
    "blocklist_anti": with_views(
        "SELECT doc_id, query_key FROM v_query_log WHERE query_key NOT IN (SELECT query_key FROM v_query_log GROUP BY 1 HAVING count(*) > 3)",
        "v_query_log",
    ),
    "natural_query": r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) >= 3 AND len(regexp_extract_all(text, '[a-zA-Zá-žÁ-Ž]{4,}')) >= 2 AS is_natural FROM documents WHERE text IS NOT NULL",
    "clean_text": with_views(rf"""SELECT doc_id, CASE WHEN length(trim(query)) < 3 OR regexp_matches(trim(query), '^\s*$|^\{{.*\}}$|^[^\p{{L}}\p{{N}}\p{{M}}_\s]{{0,3}}$') THEN NULL ELSE trim(query) END AS cleaned, regexp_matches(trim(query), '^\d{{3,}}$') AS digits,
        trim(regexp_replace(strip_accents(regexp_replace(lower(query_key), '{tx.TITLE}', '', 'gi')), '\s+', ' ', 'g')) AS name FROM v_query_log""", "v_query_log"),
    "dates_and_numbers": """SELECT doc_id, CAST(day AS VARCHAR) AS day, CAST(year(day) AS INTEGER) AS year, number, date_start, date_end, CAST(date_diff('day', CAST(date_start AS DATE), CAST(date_end AS DATE)) AS INTEGER) AS span FROM (
        SELECT doc_id, TRY_CAST(format('{:04d}-{:02d}-{:02d}', 2000 + doc_id % 30, doc_id % 14, doc_id % 35) AS DATE) AS day, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id + 0.5::DOUBLE END AS number,
               '2020-01-' || format('{:02d}', 1 + doc_id % 28) AS date_start, CASE WHEN doc_id % 2 = 0 THEN '2021-01-' ELSE '2020-01-' END || format('{:02d}', 1 + doc_id % 28) AS date_end FROM documents)""",
    "resume_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "patch_merge": "SELECT doc_id, CASE WHEN p.id IS NOT NULL THEN 'xx' ELSE lang END AS lang, CASE WHEN p.id IS NOT NULL THEN '[manual] q' || CAST(quality AS VARCHAR) END AS patch_reason FROM documents LEFT JOIN (SELECT doc_id AS id, quality FROM labels WHERE toxic = 1) p ON p.id = doc_id",
    "hash_bucket_sample": f"SELECT doc_id, lang FROM documents WHERE CASE lang WHEN 'de' THEN true WHEN 'fr' THEN false WHEN 'en' THEN {_KEY_NUMBER.format('CAST(doc_id AS VARCHAR)')} < 500 WHEN 'es' THEN {_KEY_NUMBER.format('CAST(doc_id AS VARCHAR)')} < 250 ELSE true END",
    "cluster_split": "SELECT CASE list_sum([strpos('0123456789abcdef', c) - 1 for c in string_split(sha256(source), '')]) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split, source, count(*) AS n FROM documents GROUP BY ALL",
    "text_ids": "SELECT doc_id, substr(sha1(text), 1, 16) AS text_id, sha256(text) AS sha256, CASE WHEN length('golden-v1:' || text) > 200 THEN 'golden-v1:' || sha256(text) ELSE 'golden-v1:' || text END AS source_key FROM documents WHERE text IS NOT NULL",
    "cost_estimate": with_views("""SELECT model, round(sum((prompt_tokens / 1e6 * CASE model WHEN 'gpt-5.4' THEN 1.25 WHEN 'gpt-5.4-mini' THEN 0.375 ELSE 0 END + completion_tokens / 1e6 * CASE model WHEN 'gpt-5.4' THEN 10.0 WHEN 'gpt-5.4-mini' THEN 3.0 ELSE 0 END)
        * CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END), 6)::DOUBLE AS usd, count(*) AS n FROM v_calls GROUP BY model""", "v_calls"),
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "exclusion_disjunctive": with_views(
        "SELECT query_key, supercluster_id FROM v_picks WHERE CAST(query_key AS BIGINT) NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND supercluster_id NOT IN (SELECT supercluster_id FROM v_picks JOIN labels ON doc_id = CAST(query_key AS BIGINT) WHERE toxic = 1 AND quality = 0)",
        "v_picks",
    ),
    "union_dedup": "SELECT DISTINCT substr(sha1(text), 1, 16) AS text_id FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM benchmark) WHERE text IS NOT NULL",
    "rendered_prompts": "SELECT doc_id, 'Source ' || source || ', language ' || coalesce(lang, '') || '.' AS prompt, 'Instruct: Find it' || chr(10) || 'Query: ' || source AS instructed, source || '-e-x' AS slug FROM documents",
    "seeded_order": "SELECT doc_id, lang FROM documents ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50",
    "stratified": "SELECT doc_id, lang, source, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 2",
    "sample_top_up": "SELECT doc_id, lang FROM (SELECT *, sha256('3:' || CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) ORDER BY k > 5, h, doc_id LIMIT 60",
    "cap_per_cluster": "SELECT source, doc_id, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3",
    "topn_distinct_text": with_views(
        "SELECT * FROM (SELECT source_file, query, clicks, key, row_number() OVER (PARTITION BY source_file ORDER BY clicks DESC, key) AS rank FROM (SELECT source_file, query, max(clicks) AS clicks, min_by(doc_id, (-clicks, doc_id)) AS key FROM v_query_log GROUP BY ALL)) WHERE rank <= 3",
        "v_query_log",
    ),
    "joined_top_text": with_views(
        "SELECT source_file, string_agg(query, ' | ' ORDER BY k) AS top_text FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY clicks DESC, doc_id) AS k FROM v_query_log) WHERE k <= 3 GROUP BY 1",
        "v_query_log",
    ),
    "diversity_first": "SELECT source, doc_id, n_chars, k AS cluster_rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) ORDER BY k > 1, n_chars DESC, doc_id LIMIT 30",
    "lowest_to_reserve": "SELECT doc_id, n_chars, CASE WHEN row_number() OVER (ORDER BY n_chars, doc_id) <= 40 THEN 'reserve' ELSE 'core' END AS bucket FROM documents",
    "multi_key_sort": with_views(
        "SELECT source, query_key, clicks, doc_id FROM v_query_log ORDER BY source, query_key, clicks DESC, doc_id",
        "v_query_log",
    ),
    "numbered_ids": "SELECT lang, source, n, format('{}_{:04d}', lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source)) AS id FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)",
    "category_share": "SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang",
    "set_overlap": "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'",
    "expected_splits": "SELECT source, count(DISTINCT lang) AS n_lang FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1",
}
QUERIES = {f.__name__: f for f in (
    query_log_dedup, cross_source_agg, canonical_source_pick, source_pivot, filter_flags, filter_funnel, blocklist_anti, natural_query, clean_text, dates_and_numbers, resume_anti, patch_merge, hash_bucket_sample, cluster_split, text_ids,
    cost_estimate, json_props, exclusion_disjunctive, union_dedup, rendered_prompts, seeded_order, stratified, sample_top_up, cap_per_cluster, topn_distinct_text, joined_top_text, diversity_first, lowest_to_reserve, multi_key_sort, numbered_ids,
    category_share, set_overlap, expected_splits, fuzzy_filter,
)}
