"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import Scratch


#: Rows of a written part, about.
ROWS_A_PART = 200_000


def _neighbours_least(edges: DataFrame) -> DataFrame:
    """For each node u of directed ``edges`` (u, v), the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none itself."""
    several = edges.groupBy("u").count().filter("count > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return not several.union(chained).head(1)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component, the least node that can be reached, for each node of ``edges`` (u long, v long).

    The result and the rounds are written to ``scratch``, the latter for as long as they
    are needed.  Rounds of linking all larger neighbours, then all smaller ones, to the least
    neighbour end when every node has one edge, to its component.  Each round is
    written, in as few parts as its rows need, and a node with very many edges is split in
    the joins.
    """
    own = Scratch(scratch.spark, "components")

    def keep(df: DataFrame, name: str, rows: int) -> DataFrame:
        return own.keep(df.coalesce(1 + rows // ROWS_A_PART), name)

    directed = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = own.keep(directed.distinct(), "stars")
    n = stars.count()
    while not _are_stars(stars):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(_neighbours_least(both), "least", n)
        # Each larger neighbour of u is linked to the least node that u knows.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.filter("u > v").distinct(), "large", n)
        own.drop_all_but("large")
        least = keep(_neighbours_least(large), "least", n)
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(pairs).alias("e")).select("e.*")
        stars = keep(small.filter("u > v").distinct(), "stars", n)
        own.drop_all_but("stars")
    named = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    out = scratch.keep(named, "found")
    own.drop_all_but()
    return out
