"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bpe, decontamination, exact_dedup, filter_audit, language_id, lexical_search, licences, near_dedup, nearest, packing, quality, secrets, warc
from sievelight.llm.common import held_out, read_table, spread

VOCABULARY = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


#: Session setting that names a ledger to go on with; a run scans what it doesn't hold.  Unset: a new one.
LEDGER_SETTING = "spark.sievelight.secrets.ledger"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir), spark.conf.get(LEDGER_SETTING, None))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs, language_id.train(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), VOCABULARY)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), VOCABULARY)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=4)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(read_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir), ["doc_id"])


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f for f in (
        op1_secrets,
        op2_language_id,
        op3_bpe,
        op4_nearest,
        op5_packing,
        op6_near_dedup,
        op7_quality,
        op8_warc,
        op9_exact_dedup,
        op10_licences,
        op11_decontamination,
        op12_filter_audit,
        op13_lexical_search,
    )
}


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns as the contract has them, in its order, with group and least length; then the added ones.
_SECRET_PATTERNS = (
    (
        "assign",
        """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
)


def _secrets_sql() -> str:
    """Spans from what lies between matches; letters in either case are spelled out, as DuckDB's own folding would reach beyond A-Z."""
    found = []
    for place, (kind, pattern, group, least) in enumerate(_SECRET_PATTERNS):
        pattern = pattern.replace("'", "''")
        found.append(f"""
            SELECT r, '{kind}' AS kind, {place} AS place, CAST(list_sum([length(x) for x in b[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS BIGINT) AS s, length(m[i]) AS n
            FROM (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS m, string_split_regex(text, '{pattern}') AS b FROM t), unnest(range(1, len(m) + 1)) u(i)
            WHERE length(regexp_extract(m[i], '{pattern}', {group})) >= {least}""")
    spans = " UNION ALL ".join(found)
    base = "'assign', 'access', 'hex'"
    counts = ", ".join(f"count(*) FILTER (kind = {kind}) AS n_{kind[1:-1]}" for kind in base.split(", "))
    written = "string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + n AS VARCHAR), ',' ORDER BY s, place)"
    return f"""
        WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), f AS MATERIALIZED ({spans})
        SELECT doc_id, {counts}, sha256(coalesce({written} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({written} FILTER (kind IS NOT NULL), '') AS spans
        FROM t LEFT JOIN f USING (r) GROUP BY r, doc_id"""


ORACLE_SQL = {
    "op1_secrets": _secrets_sql(),
    "op6_near_dedup": r"""
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        m AS (SELECT x AS doc_id, min(y) AS least FROM r GROUP BY x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
        FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        g AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM d LEFT JOIN g USING (payload_digest)""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                     row_number() OVER w AS k
              FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r""",
    "op11_decontamination": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) u(j)),
        g AS MATERIALIZED (SELECT r, k, CAST(j AS BIGINT) AS j, array_to_string(w[j:j + k - 1], ' ') AS g FROM t, (SELECT DISTINCT k FROM i), unnest(range(1, len(w) - k + 2)) u(j)),
        h AS MATERIALIZED (SELECT r, k, j, item_id FROM g JOIN i USING (k, g)),
        n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, k, j FROM h), unnest(range(j, j + k)) u(p) GROUP BY r),
        s AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
        FROM t LEFT JOIN n USING (r) LEFT JOIN s USING (r)""",
    "op12_filter_audit": r"""
        WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        f AS (SELECT doc_id, part, concat(
            CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
            CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' END,
            CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END) AS m FROM t),
        g AS MATERIALIZED (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
        c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT concat(a.x, b.x, d.x, e.x, f.x) AS o FROM c a, c b, c d, c e, c f WHERE len(list_distinct([a.x, b.x, d.x, e.x, f.x])) = 5),
        s AS (SELECT part, o, s, m, n, good, toxic, o[s:s] AS x, contains(m, o[s:s]) AS fails, translate(m, o[1:s - 1], '') = m AS there FROM g, o, range(1, 6) r(s))
        SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step,
            CAST(coalesce(sum(n) FILTER (there AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (there AND fails), 0) AS BIGINT) AS removed,
            CAST(coalesce(sum(n) FILTER (NOT there AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (m = x), 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(sum(good) FILTER (there AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (there AND fails), 0) AS BIGINT) AS toxic_lost,
            CAST(coalesce(sum(n * (120 // greatest(len(m), 1))) FILTER (fails), 0) AS BIGINT) AS shapley
        FROM s GROUP BY part, o, s""",
    "op13_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        c AS (SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d),
        p AS MATERIALIZED (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
        f AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM p, c GROUP BY t, nn),
        s AS (SELECT item_id, r, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll))))) AS BIGINT) AS score FROM p JOIN f USING (t) JOIN i USING (t), c GROUP BY item_id, r, doc_id),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM k WHERE rank <= 50""",
}
