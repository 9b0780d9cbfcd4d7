"""The catalogue of model tasks, from the rows that a prompt is made of to the rows of its answer.

Each task renders a prompt for a row, asks the model once for each distinct prompt and
parses the answer by the task's schema.  A prompt without an answer gives nulls or, where
an answer is a list, no row.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.functions.hashing import grade_of
from sievelight.operators.reports import axis_jobs, by_model
from sievelight.sources import providers
from sievelight.sources.storage import settled

PROMPTS = {
    "cluster_card": "Name the topic of {size} queries with the words {words}.",
    "cluster_picker": "Choose and grade queries of {cluster}: {words}.",
    "blind_verifier": "Grade the query {query}.",
    "reference": "As a reference, grade the query {query}.",
    "variants": "Rewrite {query} from grade {grade} of {axis} to the grades {targets}.",
    "axis_judge": "Judge {axis} of {query}.",
    "triage": "Grade {query} on all axes at once.",
    "counterfactual": "Paraphrase {query}, and raise and lower its grade of {axis}.",
}
#: Picks of a cluster at most, and what fields of answers may hold.
MOST_PICKS = 20
AXES = ("MU", "PU", "ET")
LEVELS = ("low", "medium", "high")
KINDS = ("oncology-core", "oncology-adjacent", "navigational", "non-clinical")
ALLOWED = {
    **{f"{a.lower()}_grade": tuple(f"{a}{g}" for g in range(3)) for a in AXES},
    **{name: (0, 1, 2) for name in ("grade", "mu", "pu", "et")},
    "confidence": (1, 2, 3, 4, 5),
    "clinical_relevance": KINDS,
    "urgency_potential": LEVELS,
    "emotional_potential": LEVELS,
}
LONGEST = {"label": 200, "text": 2000, "query": 2000, "paraphrase": 2000, "up": 2000, "down": 2000}


def check(value, name: str = "") -> None:
    """Raises ValueError where a field of an answer, however deep, holds what it may not; null and absent fields are fine."""
    if isinstance(value, dict):
        for k, v in value.items():
            check(v, k)
    elif isinstance(value, list):
        for v in value:
            check(v, name)
    elif value is not None:
        if name in ALLOWED and (isinstance(value, bool) or value not in ALLOWED[name]):
            raise ValueError(f"{name} can't be {value!r}")
        if name in LONGEST and (not isinstance(value, str) or len(value) > LONGEST[name]):
            raise ValueError(f"{name} is no text of up to {LONGEST[name]} characters")


def checked(answer: providers.Answer) -> providers.Answer:
    """The model, whose answers that are no JSON object, or that :func:`check` refuses, count as failed calls and are asked for again."""

    def run(*prompt: str) -> tuple[str, int, int]:
        said, *tokens = answer(*prompt)
        found = json.loads(said)
        if not isinstance(found, dict):
            raise ValueError("the answer is no object")
        check(found)
        return said, *tokens

    return run


def ask(
    rows: DataFrame,
    task: str,
    key: str,
    answer: providers.Answer,
    model: str,
    fields: dict[str, Column],
    template: str | None = None,
    more: dict[str, Column] | None = None,
    **options,
) -> DataFrame:
    """key and the fields of each row's answer, by a prompt that ``fields`` fill.

    ``template`` takes the place of the task's own prompt.  It may have a part for the system, marked
    [SYSTEM], before one for the user, marked [USER]; the model then gets both, user first.  ``more`` are columns of
    ``rows`` for further names in it.  The answers are checked, and written, so a model is asked once however often they are used.
    """
    system, user = tx.sections(template) if template and "[USER]" in template else ("", template or PROMPTS[task])
    filled = {**fields, **(more or {})}
    prompts = rows.select(key, tx.render(user, **filled).alias("prompt"), *([tx.render(system, **filled).alias("system")] if system else []))
    answers = providers.call_model(
        prompts, checked(answer), model, task, key, system="system" if system else None, **options
    )
    return providers.parsed(settled(answers), task, [key])


def cluster_cards(clusters: DataFrame, answer: providers.Answer, model: str, **options) -> DataFrame:
    """``clusters`` (cluster_id, size, words) with the card's fields; id and size are always the cluster's own."""
    fields = {"size": F.col("size"), "words": F.col("words")}
    return clusters.select("cluster_id", "size").join(
        ask(clusters, "cluster_card", "cluster_id", answer, model, fields, **options), "cluster_id"
    )


def cluster_picks(
    clusters: DataFrame, answer: providers.Answer, model: str, **options
) -> tuple[DataFrame, DataFrame]:
    """The graded picks of each cluster, at most ``MOST_PICKS``, and the clusters without any, with the reason."""
    fields = {"cluster": F.col("cluster_id"), "words": F.col("words")}
    said = ask(clusters, "cluster_picker", "cluster_id", answer, model, fields, **options)
    picks = said.select("cluster_id", F.explode(F.slice("picks", 1, MOST_PICKS)).alias("p")).select(
        "cluster_id", F.col("p.query").alias("query_text"), "p.mu_grade", "p.pu_grade", "p.et_grade"
    )
    dead = said.filter(F.coalesce(F.size("picks"), F.lit(0)) < 1).select("cluster_id", "skip_reason")
    return picks, dead


def grades(
    queries: DataFrame, answer: providers.Answer, model: str, task: str = "blind_verifier", **options
) -> DataFrame:
    """query_key, a grade of each axis and whether it applies, and the confidence; by the verifier or the reference."""
    return ask(queries, task, "query_key", answer, model, {"query": F.col("query_text")}, **options)


def variants(
    anchors: DataFrame, targets: tuple[int, ...], answer: providers.Answer, model: str, **options
) -> DataFrame:
    """Rewritten anchors (axis, query_key, query_text, grade): axis, query_key, anchor_grade, target_grade, text.

    Those of the anchor's own grade and of grades that weren't asked for are dropped.
    """
    others = F.array_join(
        F.transform(
            F.filter(F.array(*map(F.lit, targets)), lambda t: t != F.col("grade")), lambda t: t.cast("string")
        ), ","
    )
    jobs = anchors.withColumn("job", F.concat_ws("/", "axis", "query_key"))
    fields = {"query": F.col("query_text"), "grade": F.col("grade"), "axis": F.col("axis"), "targets": others}
    made = ask(jobs, "variants", "job", answer, model, fields, **options).select("job", F.explode("variants").alias("v"))
    named = made.join(jobs.select("job", "axis", "query_key", F.col("grade").alias("anchor_grade")), "job")
    return named.select("axis", "query_key", "anchor_grade", "v.target_grade", "v.text").filter(
        F.col("target_grade").isin(*targets) & (F.col("target_grade") != F.col("anchor_grade"))
    )


def confirmed(made: DataFrame, answer: providers.Answer, model: str, **options) -> DataFrame:
    """Variants with the judge's grade and confidence, and whether it is the grade that was aimed at."""
    jobs = made.withColumn("job", F.concat_ws("/", "axis", "query_key", "target_grade", "text"))
    fields = {"axis": F.col("axis"), "query": F.col("text")}
    judged = ask(jobs.dropDuplicates(["job"]), "axis_judge", "job", answer, model, fields, **options)
    named = judged.select("job", F.col("grade").alias("judged_grade"), "confidence")
    return jobs.join(named, "job").drop("job").withColumn(
        "confirmed", F.coalesce(F.col("judged_grade") == F.col("target_grade"), F.lit(False))
    )


def axis_grades(
    queries: DataFrame,
    answer: providers.Answer,
    model: str,
    axes: tuple[str, ...] = AXES,
    done: DataFrame | None = None,
    **options,
) -> DataFrame:
    """query_key, axis, grade and confidence of each query and axis that isn't done yet."""
    jobs = axis_jobs(queries, axes, done).join(queries.select("query_key", "query_text"), "query_key")
    jobs = jobs.withColumn("job", F.concat_ws("/", "axis", "query_key"))
    fields = {"axis": F.col("axis"), "query": F.col("query_text")}
    said = ask(jobs, "axis_judge", "job", answer, model, fields, **options)
    return jobs.select("job", "query_key", "axis").join(said, "job").drop("job")


def triage(queries: DataFrame, answer: providers.Answer, model: str, **options) -> DataFrame:
    """query_key and the grades of all three axes from one call."""
    return ask(queries, "triage", "query_key", answer, model, {"query": F.col("query_text")}, **options)


def edits(anchors: DataFrame, answer: providers.Answer, model: str, **options) -> DataFrame:
    """axis, query_key, paraphrase, up and down of each anchor; an empty flip is null."""
    jobs = anchors.withColumn("job", F.concat_ws("/", "axis", "query_key"))
    fields = {"query": F.col("query_text"), "axis": F.col("axis")}
    said = ask(jobs, "counterfactual", "job", answer, model, fields, **options)
    flips = {c: F.nullif(F.trim(c), F.lit("")) for c in ("up", "down")}
    return jobs.select("job", "axis", "query_key").join(said, "job").drop("job").withColumns(flips)


def compared_generators(
    anchors: DataFrame, targets: tuple[int, ...], answers: dict[str, providers.Answer], **options
) -> DataFrame:
    """The variants of several models side by side: axis, query_key, target_grade, a column for each model, n_models."""
    every = [variants(anchors, targets, a, m, **options).withColumn("model", F.lit(m)) for m, a in answers.items()]
    keys = ["axis", "query_key", "target_grade"]
    return by_model(reduce(lambda a, b: a.unionByName(b), every), keys, "model", list(answers), "text")


def grade_numbers(graded: DataFrame) -> DataFrame:
    """Grade tokens as numbers: mu, pu and et."""
    return graded.withColumns({a.lower(): grade_of(F.col(f"{a.lower()}_grade")) for a in AXES})
