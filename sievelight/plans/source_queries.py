"""Queries that go through files: tables are written in a reader's format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import clusters as cl
from sievelight.plans import stand_ins, views
from sievelight.plans.views import with_views
from sievelight.sources import providers, readers, writers
from sievelight.sources.snapshots import SnapshotTable
from sievelight.sources.storage import table, work_dir
from sievelight.streaming.incremental import embed_stream

#: Lines of an export's file, about.
LINES = 50_000


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a CSV file of customers."""
    path = _new_folder(spark, "customers")
    rows = table(spark, sf_dir, "customer")
    writers.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").csv(path).select("c_custkey", "c_mktsegment")


def appended_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a partitioned table to which the open ones were appended."""
    path = _new_folder(spark, "orders")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    writers.write_table(orders.filter("o_orderstatus <> 'O'"), path)
    writers.append_table(orders.filter("o_orderstatus = 'O'"), path)
    return spark.read.schema(orders.schema).parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def updated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after the open ones were added to the others and every seventh was put in another state."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    held = SnapshotTable(spark, _new_folder(spark, "states"))
    held.replace(orders.filter("o_orderstatus <> 'O'"))
    held.append(orders.filter("o_orderstatus = 'O'"))
    held.upsert(orders.filter("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])
    held.clean()
    return held.read()


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON lines, in two goes."""
    path = _new_folder(spark, "turns")
    turns = table(spark, sf_dir, "conversations")
    writers.write_records(turns.filter("role = 'user'"), path)
    writers.write_records(turns.filter("role <> 'user'"), path, append=True)
    return readers.read_records(spark, path, "conv_id long, turn long, role string, text string")


def employee_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from one JSON document a region, here of its nations."""
    path = _new_folder(spark, "employees")
    named = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")  # five rows
    )
    people = F.collect_list(F.struct(F.col("n_name").alias("firstname"), F.col("r_name").alias("lastname")))
    documents = named.groupBy("n_regionkey").agg(F.to_json(F.struct(people.alias("data"))).alias("value"))
    documents.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return readers.read_employees(spark, path)


def latest_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of the responses of each key, from a folder with a JSON file for each; here of each region's nations."""
    path = _new_folder(spark, "responses")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("query"), F.col("n_name").alias("response"), F.col("n_nationkey").alias("at")
    )
    nations.write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_responses(spark, path, "query int, response string, at int", ["query"], "at")


def ga4_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log by way of exports: comments, a blank line, a localised header and lines in any order."""
    path = _new_folder(spark, "ga4")
    log = views.query_log(spark, sf_dir)
    text = F.regexp_replace(F.concat_ws(" ", F.concat(F.lit("k"), "doc_id"), "query"), r"\s+", " ")
    line = F.struct(
        text.alias("q"), "clicks", "impressions", F.coalesce("ctr", F.lit(0.5)).alias("ctr"), (F.col("doc_id") % 7 + 0.5).alias("position")
    )
    parts = max(1, -(-log.count() // LINES))
    lines = log.select(F.to_csv(line).alias("value"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"))
    head = F.array(*map(F.lit, ("# Report", "# 20250101-20250131", "", "Dotaz,Kliky,Imprese,CTR,Pozice")))
    heads = spark.range(parts).select(F.explode(head).alias("value"), F.col("id").alias("part"))
    lines.unionByName(heads).repartition(parts, "part").write.partitionBy("part").text(path)
    return readers.read_ga4(spark, path).select(
        "query", "clicks", "impressions", F.round("ctr", 6).alias("ctr"), "position", "date_start", "date_end"
    )


def internal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log by way of an internal export, with days that don't exist and numbers that are none."""
    path = _new_folder(spark, "internal")
    d = F.col("doc_id")
    day = F.format_string("%d. %d. %d 10:30", d % 31 + 1, d % 13 + 1, d % 30 + 2000)
    rows = views.query_log(spark, sf_dir).select(
        F.concat_ws(" ", F.concat(F.lit("k"), "doc_id"), "query").alias("query"),
        "lang",
        F.when(d % 5 == 0, "many").otherwise(F.col("clicks").cast("string")).alias("clicks"),
        (d % 9).cast("string").alias("found"),
        day.alias("last_searched_raw"),
    )
    writers.write_csv(rows.withColumn("query", F.regexp_replace("query", r"\s+", " ")), path)
    return readers.read_internal(spark, path).select("query", "lang", "clicks", "found", "last_searched", "last_year")


def merged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each source's clusters, here languages, the largest cluster's first and each once."""
    sized = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    words = F.array(F.col("lang"), F.concat(F.lit("w"), (F.col("n") % 5).cast("string")), F.lit("all"))
    merged = cl.merged_words(sized.select("source", F.col("lang").alias("cluster_id"), "n", words.alias("w")), ["source"], "w", "n")
    return merged.select("source", F.array_join("w", " ").alias("words"))


def call_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, failures, cached answers and tokens of a run in which half of the answers were there already."""
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null").select(
        "doc_id", F.concat(F.lit("Judge document "), F.col("doc_id").cast("string")).alias("prompt")
    )
    first = providers.call_model(docs.filter("doc_id % 2 = 0"), stand_ins.grade_by_words, "stand-in", "axis_judge", "doc_id")
    cache = first.select("cache_key", "response", "prompt_tokens", "completion_tokens")
    return providers.usage(
        providers.call_model(docs, stand_ins.grade_by_words, "stand-in", "axis_judge", "doc_id", cache=cache)
    )


def streamed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the benchmark's texts, embedded by micro-batches of a stream over its files."""
    path = _new_folder(spark, "stream")
    items = table(spark, sf_dir, "benchmark").select(F.sha1("text").alias("text_id"), "text")
    items.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    embed_stream(stream, providers.HashedEmbedder(), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("text_id", F.size("embedding").alias("dim"), "error")


ORACLE = {
    "csv_columns": "SELECT c_custkey, c_mktsegment FROM customer",
    "appended_table": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "updated_table": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
    "json_records": "SELECT conv_id, turn, role, text FROM conversations",
    "employee_names": "SELECT n_name AS firstname, r_name AS lastname FROM nation JOIN region ON r_regionkey = n_regionkey",
    "latest_responses": "SELECT CAST(n_regionkey AS INTEGER) AS query, arg_max(n_name, n_nationkey) AS response, CAST(max(n_nationkey) AS INTEGER) AS at FROM nation GROUP BY 1",
    "ga4_log": with_views(
        r"SELECT regexp_replace('k' || doc_id || ' ' || query, '\s+', ' ', 'g') AS query, clicks, impressions, round(coalesce(ctr, 0.5), 6) AS ctr, doc_id % 7 + 0.5::DOUBLE AS position, '2025-01-01' AS date_start, '2025-01-31' AS date_end FROM v_query_log",
        "v_query_log",
    ),
    "internal_log": with_views(
        r"""SELECT query, lang, clicks, found, CAST(day AS VARCHAR) AS last_searched, year(day) AS last_year FROM (
          SELECT regexp_replace('k' || doc_id || ' ' || query, '\s+', ' ', 'g') AS query, lang, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE clicks END AS clicks, doc_id % 9 AS found,
                 TRY_CAST(format('{:04d}-{:02d}-{:02d}', doc_id % 30 + 2000, doc_id % 13 + 1, doc_id % 31 + 1) AS DATE) AS day FROM v_query_log)""",
        "v_query_log",
    ),
    "merged_words": """
        WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
        w AS (SELECT source, n, lang, unnest([lang, 'w' || n % 5, 'all']) AS word, unnest([1, 2, 3]) AS place FROM c),
        f AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang, place) AS nth FROM w),
        o AS (SELECT source, word, min(nth) AS nth FROM f GROUP BY ALL)
        SELECT source, string_agg(word, ' ' ORDER BY nth) AS words FROM o GROUP BY source""",
    "call_usage": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_failed, count(*) FILTER (doc_id % 2 = 0) AS n_cached, 3 * count(*) FILTER (doc_id % 2 <> 0) AS prompt_tokens, 8 * count(*) FILTER (doc_id % 2 <> 0) AS completion_tokens FROM documents",
    "streamed_vectors": "SELECT DISTINCT sha1(text) AS text_id, 64 AS dim, CAST(NULL AS VARCHAR) AS error FROM benchmark",
}
QUERIES = {f.__name__: f for f in (
    csv_columns, appended_table, updated_table, json_records, employee_names, latest_responses, ga4_log, internal_log, merged_words, call_usage, streamed_vectors,
)}
