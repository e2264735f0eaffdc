"""Problem 5: the N highest-scoring items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm._candidates import current_candidates, tidy
from panelforge.llm._positions import positions


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, out: str = "position") -> DataFrame:
    """Rows of ``df`` among the first ``n`` of their group, with their exact position in ``out``.

    Global range-partitioned sort on group and order; counts of each partition are summed up over the partitions before
    (see ``positions``). A group of any size spreads over many tasks. ``order`` should end with an identifier, so that
    ties are settled alike each time. Null group values form a group; an empty input gives no rows; ``n`` below 1 is an
    error. Repeated rows count as rows of their own: drop them first if they should not.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    return positions(df, group, order, out, keep=n)


def scored_candidates(candidates: DataFrame) -> DataFrame:
    """Current candidates with a family and a score: null families, null and NaN scores take no part."""
    rows = current_candidates(
        candidates,
        {"run_id": F.col("run_id"), "root_family": tidy("root_family"), "structural_score": F.col("structural_score"), "nodes": F.col("nodes"), "fingerprint": F.col("fingerprint")},
    )
    return rows.filter(F.col("root_family").isNotNull() & F.col("structural_score").isNotNull() & ~F.isnan("structural_score"))


def top_candidates(candidates: DataFrame, n: int = 3) -> DataFrame:
    """run_id, root_family, candidate_id, structural_score, position of the ``n`` best of each run and family.

    Score descending, then nodes, fingerprint and candidate_id ascending; null nodes or fingerprints come last of a tie.
    """
    order = [F.col("structural_score").desc(), F.col("nodes").asc_nulls_last(), F.col("fingerprint").asc_nulls_last(), F.col("candidate_id").asc()]
    top = top_n_per_group(scored_candidates(candidates), ["run_id", "root_family"], order, n)
    return top.select("run_id", "root_family", "candidate_id", "structural_score", "position")
