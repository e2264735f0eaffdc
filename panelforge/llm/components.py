"""Connected components as representative mappings, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.plans.lineage import cut


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u of another edge: each component is its smallest node with all others."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    per = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    r = per.agg(F.max(F.col("child") + F.when(F.col("child") > 0, F.col("parent")).otherwise(0)).alias("most")).first()
    return (r["most"] or 0) <= 1


def components(links: DataFrame) -> DataFrame:
    """node, rep (smallest node of its component) for every node of ``links`` (a, b; any direction, repeats allowed).

    Alternates, until all components are stars: every node points its larger neighbours to the smallest neighbour, then
    its smaller neighbours to the smallest. Rounds grow with the logarithm of a component's length; each is two
    aggregations with partial sums, so a hub is no burden to one task. Null ends are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges = cut(edges)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()
        edges = cut(small)
    reps = edges.select(F.col("u").alias("node"), F.col("v").alias("rep"))
    return reps.unionByName(reps.select(F.col("rep").alias("node"), "rep").distinct())
