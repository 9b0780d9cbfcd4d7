"""Queries of the model tasks, answered by stand-ins whose answers SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import backfill, tasks
from sievelight.plans import stand_ins, views
from sievelight.plans.golden_queries import _POOL, _WEIGHT, _anchors
from sievelight.plans.views import with_views
from sievelight.sources.storage import table

MODEL = "stand-in"
TARGET_GRADES = (0, 1, 2)
#: Quotas of the two cells that are filled up.
QUOTAS = {"MU2": 120, "PU2": 100}


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.picks(spark, sf_dir).groupBy(F.col("supercluster_id").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("size"), F.min("clinical_relevance").alias("words")
    )


def _anchored(spark: SparkSession, sf_dir: str, axis: str) -> DataFrame:
    return _anchors(spark, sf_dir).filter(F.col("axis") == axis).select("axis", "query_key", "query_text", "grade")


def cluster_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.cluster_cards(_clusters(spark, sf_dir), stand_ins.stand_in("cluster_card"), MODEL)


def cluster_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.cluster_picks(_clusters(spark, sf_dir), stand_ins.stand_in("cluster_picker"), MODEL)[0]


def dead_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.cluster_picks(_clusters(spark, sf_dir), stand_ins.stand_in("cluster_picker"), MODEL)[1]


def blind_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.grades(views.picks(spark, sf_dir), stand_ins.stand_in("blind_verifier"), MODEL)


def reference_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.grades(views.picks(spark, sf_dir), stand_ins.stand_in("reference"), MODEL, "reference")


def confirmed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tasks.variants(_anchored(spark, sf_dir, "MU"), TARGET_GRADES, stand_ins.stand_in("variants"), MODEL)
    return tasks.confirmed(made, stand_ins.stand_in("axis_judge"), MODEL)


def axis_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("query_key"), F.lit("MU").alias("axis"))
    return tasks.axis_grades(views.picks(spark, sf_dir), stand_ins.stand_in("axis_judge"), MODEL, done=done)


def triage_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.triage(views.picks(spark, sf_dir), stand_ins.stand_in("triage"), MODEL)


def counterfactual_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.edits(_anchored(spark, sf_dir, "PU"), stand_ins.stand_in("counterfactual"), MODEL)


def generated_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = {"one": stand_ins.stand_in("variants"), "two": stand_ins.stand_in("variants", "two:")}
    return tasks.compared_generators(_anchored(spark, sf_dir, "ET"), TARGET_GRADES, answers)


def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short cells filled with generated and verified queries that replace the most dispensable picks."""
    out = backfill.backfill(
        views.picks(spark, sf_dir), stand_ins.stand_in("backfill"), stand_ins.judged_backfill, MODEL, QUOTAS
    )
    return out.select("query_key", "origin", "mu_grade", "pu_grade", "et_grade")


def _number(prompt: str) -> str:
    return f"CAST(list_sum([strpos('0123456789abcdef', c) - 1 for c in string_split(sha256({prompt}), '')]) % 15 AS INTEGER)"


_CLUSTERS = "(SELECT supercluster_id AS cluster_id, count(*) AS size, min(clinical_relevance) AS words FROM v_picks GROUP BY 1)"
_CARD = _number("'Name the topic of ' || size || ' queries with the words ' || words || '.'")
_PICK = _number("'Choose and grade queries of ' || cluster_id || ': ' || words || '.'")
_JUDGED = "'MU' || d % 3 AS mu_grade, d % 2 > 0 AS mu_applicable, 'PU' || (d + 1) % 3 AS pu_grade, d % 3 > 0 AS pu_applicable, 'ET' || (d + 2) % 3 AS et_grade, d % 4 > 0 AS et_applicable, CAST(1 + d % 5 AS INTEGER) AS confidence"
_OTHERS = "CASE grade WHEN 0 THEN '1,2' WHEN 1 THEN '0,2' ELSE '0,1' END"
_REWRITE = "'Rewrite ' || query_text || ' from grade ' || grade || ' of ' || axis || ' to the grades ' || " + _OTHERS + " || '.'"


def _variants(axis: str, salt: str = "") -> str:
    return f"""(SELECT axis, query_key, grade AS anchor_grade, CAST(g AS INTEGER) AS target_grade, 'variant ' || d || ' ' || g AS text
        FROM (SELECT *, {_number(f"'{salt}' || {_REWRITE}")} AS d FROM {_POOL} WHERE axis = '{axis}'), range(3) r(g) WHERE g <= d % 4 AND g <> grade)"""


def _made(cell: str, axis: str, anchor: str) -> str:
    top = f"SELECT supercluster_id, count(*) AS n FROM v_picks WHERE {axis}_grade = '{anchor}' GROUP BY 1 ORDER BY {_WEIGHT.replace('clinical_relevance', 'min(clinical_relevance)')} DESC, n DESC, supercluster_id LIMIT 20"
    prompt = f"'Write queries of grade {cell} for the topic ' || supercluster_id || '.'"
    return f"SELECT '{cell}' AS cell, supercluster_id, 'made ' || d || ' ' || k AS query_key FROM (SELECT *, {_number(prompt)} AS d FROM ({top})), range(5) r(k)"


_FILLED = f"""
    made AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY cell, supercluster_id) AS nth FROM ({_made("MU2", "mu", "MU1")} UNION ALL {_made("PU2", "pu", "PU1")})
             WHERE (cell = 'MU2' AND (SELECT count(*) FROM v_picks WHERE mu_grade = 'MU2') < {QUOTAS["MU2"]}) OR (cell = 'PU2' AND (SELECT count(*) FROM v_picks WHERE pu_grade = 'PU2') < {QUOTAS["PU2"]})),
    graded AS (SELECT cell, query_key, 'MU' || CASE WHEN d % 2 > 0 THEN 2 ELSE 0 END AS mu_grade, 'PU' || CASE WHEN d % 3 > 0 THEN 2 ELSE 0 END AS pu_grade, 'ET1' AS et_grade, 1 + d % 5 AS confidence
               FROM (SELECT *, {_number("'Grade the query ' || query_key || '.'")} AS d FROM made WHERE nth = 1 AND query_key NOT IN (SELECT query_key FROM v_picks))),
    new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY confidence DESC, query_key) AS k FROM graded WHERE cell IN (mu_grade, pu_grade))
            WHERE k <= CASE cell WHEN 'MU2' THEN {QUOTAS["MU2"]} - (SELECT count(*) FROM v_picks WHERE mu_grade = 'MU2') ELSE {QUOTAS["PU2"]} - (SELECT count(*) FROM v_picks WHERE pu_grade = 'PU2') END)"""
_SPARE = f"row_number() OVER (PARTITION BY mu_grade = 'MU0' AND pu_grade = 'PU0' ORDER BY CASE et_grade WHEN 'ET2' THEN 0 WHEN 'ET0' THEN 2 ELSE 1 END, least(mu_confidence, pu_confidence, et_confidence), {_WEIGHT}, query_key)"


def _sql(query: str, *names: str) -> str:
    return with_views(query, *(names or ("v_picks",)))


ORACLE = {
    "cluster_cards": _sql(
        f"SELECT cluster_id, size, 'topic ' || d AS label, ['oncology-core', 'oncology-adjacent', 'navigational', 'non-clinical'][d % 4 + 1] AS clinical_relevance, ['low', 'medium', 'high'][d % 3 + 1] AS urgency_potential, ['low', 'medium', 'high'][(d + 1) % 3 + 1] AS emotional_potential FROM (SELECT *, {_CARD} AS d FROM {_CLUSTERS})"
    ),
    "cluster_picks": _sql(
        f"SELECT cluster_id, 'pick ' || d || ' ' || k AS query_text, 'MU' || (d + k) % 3 AS mu_grade, 'PU' || (d + k + 1) % 3 AS pu_grade, 'ET' || (d + k + 2) % 3 AS et_grade FROM (SELECT *, {_PICK} AS d FROM {_CLUSTERS}), range(3) r(k) WHERE k < d % 4"
    ),
    "dead_clusters": _sql(
        f"SELECT cluster_id, 'nothing fits' AS skip_reason FROM (SELECT *, {_PICK} AS d FROM {_CLUSTERS}) WHERE d % 4 = 0"
    ),
    "blind_grades": _sql(
        f"SELECT query_key, {_JUDGED} FROM (SELECT *, {_number("'Grade the query ' || query_text || '.'")} AS d FROM v_picks)"
    ),
    "reference_grades": _sql(
        f"SELECT query_key, {_JUDGED} FROM (SELECT *, {_number("'As a reference, grade the query ' || query_text || '.'")} AS d FROM v_picks)"
    ),
    "confirmed_variants": _sql(
        f"SELECT * EXCLUDE (d), CAST(d % 3 AS INTEGER) AS judged_grade, CAST(1 + d // 3 AS INTEGER) AS confidence, d % 3 = target_grade AS confirmed FROM (SELECT *, {_number("'Judge ' || axis || ' of ' || text || '.'")} AS d FROM {_variants('MU')})"
    ),
    "axis_grades": _sql(
        f"SELECT query_key, axis, CAST(d % 3 AS INTEGER) AS grade, CAST(1 + d // 3 AS INTEGER) AS confidence FROM (SELECT *, {_number("'Judge ' || axis || ' of ' || query_text || '.'")} AS d FROM v_picks, (SELECT unnest(['MU', 'PU', 'ET']) AS axis) WHERE NOT (axis = 'MU' AND CAST(query_key AS BIGINT) IN (SELECT doc_id FROM labels)))"
    ),
    "triage_grades": _sql(
        f"SELECT query_key, CAST(d % 3 AS INTEGER) AS mu, CAST((d + 1) % 3 AS INTEGER) AS pu, CAST((d + 2) % 3 AS INTEGER) AS et FROM (SELECT *, {_number("'Grade ' || query_text || ' on all axes at once.'")} AS d FROM v_picks)"
    ),
    "counterfactual_edits": _sql(
        f"SELECT axis, query_key, 'like ' || d AS paraphrase, CASE WHEN d % 5 > 0 THEN 'up ' || d END AS up, CASE WHEN d % 3 > 0 THEN 'down ' || d END AS down FROM (SELECT *, {_number("'Paraphrase ' || query_text || ', and raise and lower its grade of ' || axis || '.'")} AS d FROM {_POOL} WHERE axis = 'PU')"
    ),
    "generated_by_two": _sql(
        f"SELECT axis, query_key, target_grade, min(text) FILTER (m = 1) AS one, min(text) FILTER (m = 2) AS two, count(DISTINCT m) AS n_models FROM (SELECT *, 1 AS m FROM {_variants('ET')} UNION ALL SELECT *, 2 AS m FROM {_variants('ET', 'two:')}) GROUP BY ALL"
    ),
    "backfilled": _sql(
        f"SELECT query_key, 'picked' AS origin, mu_grade, pu_grade, et_grade FROM (SELECT *, CASE WHEN mu_grade = 'MU0' AND pu_grade = 'PU0' THEN {_SPARE} END AS k FROM v_picks) WHERE k IS NULL OR k > (SELECT count(*) FROM new) UNION ALL SELECT query_key, 'synthesized', mu_grade, pu_grade, et_grade FROM new"
    ).replace("\nSELECT query_key, 'picked'", f",{_FILLED}\nSELECT query_key, 'picked'", 1),
}
QUERIES = {f.__name__: f for f in (
    cluster_cards, cluster_picks, dead_clusters, blind_grades, reference_grades, confirmed_variants, axis_grades, triage_grades, counterfactual_edits, generated_by_two, backfilled,
)}
