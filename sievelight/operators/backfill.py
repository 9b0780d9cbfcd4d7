"""Filling the short cells of a golden set with generated and verified queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators import golden
from sievelight.operators.ranking import head_per_group
from sievelight.operators.sets import new_texts
from sievelight.operators.tasks import ask
from sievelight.sources import providers
from sievelight.sources.storage import settled

#: Cells that are filled, the axis of each and the grade whose clusters suggest its topics.
CELLS = {"MU2": ("mu", "MU1"), "PU2": ("pu", "PU1")}
ASK = "Write queries of grade {cell} for the topic {label}."
CHECK = "Grade the query {query}."


def short_cells(picks: DataFrame, targets: dict[str, int] = golden.TARGETS) -> dict[str, int]:
    """How many items each fillable cell lacks; cells that lack none are left out."""
    rows = golden.shortfall(picks, targets).filter(F.col("cell").isin(*CELLS) & (F.col("shortfall") > 0)).collect()
    return {r["cell"]: r["shortfall"] for r in rows}


def generate(
    picks: DataFrame, cells: list[str], answer: providers.Answer, model: str, most_clusters: int = 20, template: str = ASK
) -> DataFrame:
    """Generated queries of the cells: cell, supercluster_id, clinical_relevance, query_text and query_key."""
    jobs = []
    for cell in cells:
        axis, anchor = CELLS[cell]
        jobs.append(golden.relevant_clusters(picks, axis, anchor, most_clusters).withColumn("cell", F.lit(cell)))
    rows = reduce(lambda a, b: a.unionByName(b), jobs).withColumn("job", F.concat_ws("/", "cell", "supercluster_id"))
    fields = {"cell": F.col("cell"), "label": F.col("supercluster_id")}
    said = ask(rows, "backfill", "job", answer, model, fields, template)
    made = said.select("job", F.explode("generated").alias("g"))
    named = made.join(rows.select("job", "cell", "supercluster_id", "clinical_relevance"), "job")
    query = F.col("g.query").alias("query_text")
    return named.select(
        "cell", "supercluster_id", "clinical_relevance", query, tx.fold(F.col("g.query")).alias("query_key")
    )


def verified(candidates: DataFrame, answer: providers.Answer, model: str, template: str = CHECK) -> DataFrame:
    """Candidates whose blind grade is the cell they were written for, with all grades and the confidence."""
    said = ask(candidates, "blind_verifier", "query_key", answer, model, {"query": F.col("query_text")}, template)
    graded = candidates.join(said, "query_key")
    axis = F.substring("cell", 1, 2)
    own = F.when(axis == "MU", F.col("mu_grade")).when(axis == "PU", F.col("pu_grade")).otherwise(F.col("et_grade"))
    return graded.filter(own == F.col("cell"))


def backfill(
    picks: DataFrame,
    write: providers.Answer,
    judge: providers.Answer,
    model: str,
    targets: dict[str, int] = golden.TARGETS,
    most_clusters: int = 20,
    templates: tuple[str, str] = (ASK, CHECK),
) -> DataFrame:
    """The set in which generated queries of short cells replace its most dispensable picks.

    Queries that the set has already, and repeated ones, are dropped before they are
    verified; of the rest the surest fill each cell's shortfall.  Models are called once:
    their answers are checkpointed.
    """
    short = short_cells(picks, targets)
    base = picks.withColumn("category_weight", golden.lookup(F.col("clinical_relevance"), golden.CATEGORY_WEIGHT, 0.0))
    if not short:
        return base.withColumn("origin", F.lit("picked"))
    candidates = settled(generate(picks, sorted(short), write, model, most_clusters, templates[0]))
    fresh = new_texts(candidates, picks, "query_key", F.col("cell"), F.col("supercluster_id"))
    kept = head_per_group(
        verified(fresh, judge, model, templates[1]), ["cell"], max(short.values()), F.desc("confidence"), F.asc("query_key")
    )
    lacking = golden.lookup(F.col("cell"), short, 0)
    kept = settled(kept.filter(F.col("rank") <= lacking))
    made = kept.select(
        "query_key", "query_text", "supercluster_id", "clinical_relevance", "mu_grade", "pu_grade", "et_grade",
        *(F.col("confidence").alias(f"{a}_confidence") for a in golden.AXES),
    )
    return golden.backfilled(base, made)
