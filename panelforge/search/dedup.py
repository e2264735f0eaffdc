"""Partition of candidate formulas into accepted, duplicate and rejected."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.expr.analysis import analyze
from panelforge.expr.canonical import canonical, fingerprint
from panelforge.expr.catalog import Catalog, builtin
from panelforge.expr.parser import parse
from panelforge.plans.workers import ship

ANALYSIS = "canonical string, fingerprint string, semantic_fingerprint string, reason string, nodes int, depth int, root_family string, error string"


def analyzed(df: DataFrame, expression: str, catalog: Catalog | None = None) -> DataFrame:
    """``df`` with a struct ``analysis`` of its formulas; error says why a formula (or a null) isn't valid.

    Formulas are short texts, parsed in Arrow batches; equal texts of a batch are analysed once.
    """
    catalog = catalog or builtin()

    @F.pandas_udf(ANALYSIS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ANALYSIS.split(", ")]
        for texts in batches:
            known: dict = {}
            for text in texts.unique():
                try:
                    if text is None or text != text:
                        raise ValueError("no expression")
                    node = parse(text, catalog)
                    a = analyze(node)
                    known[text] = (canonical(node), fingerprint(node), a.semantic_fingerprint, a.rejection_reason, node.node_count, node.depth, node.operator or node.name, None)
                except ValueError as e:
                    known[text] = (*[None] * 7, str(e))
            yield pd.DataFrame([known[t] for t in texts], columns=names).astype({"nodes": "Int32", "depth": "Int32"})

    ship(df.sparkSession)
    return df.withColumn("analysis", run(F.col(expression)))


def partition(df: DataFrame, position: str, expression: str, catalog: Catalog | None = None) -> DataFrame:
    """``position``, status, reason, duplicate_of and the analysis of each formula, in order of ``position``.

    rejected: proven zero or constant; accepted: the first of its semantic fingerprint; duplicate: a later one, with the
    position of the first; invalid formulas have status invalid and the error as reason. The first of a fingerprint is
    found by an aggregation with partial minima, so one fingerprint may hold any share of the rows.
    """
    rows = analyzed(df.select(position, expression), expression, catalog)
    open_ = F.col("analysis.error").isNull() & F.col("analysis.reason").isNull()
    firsts = rows.filter(open_).groupBy(F.col("analysis.semantic_fingerprint").alias("__fp")).agg(F.min(position).alias("__first"))
    joined = rows.join(firsts, F.when(open_, F.col("analysis.semantic_fingerprint")) == F.col("__fp"), "left")
    status = F.when(F.col("analysis.error").isNotNull(), "invalid").when(F.col("analysis.reason").isNotNull(), "rejected").when(F.col(position) == F.col("__first"), "accepted").otherwise("duplicate")
    out = joined.withColumn("status", status).withColumn("reason", F.coalesce("analysis.error", "analysis.reason"))
    return out.withColumn("duplicate_of", F.when(F.col("status") == "duplicate", F.col("__first"))).drop("__fp", "__first")


def rejection_counts(partitioned: DataFrame) -> DataFrame:
    return partitioned.filter("status = 'rejected'").groupBy("reason").agg(F.count("*").alias("n"))


def new_only(partitioned: DataFrame, known: DataFrame, fingerprint_column: str) -> DataFrame:
    """Accepted rows whose semantic fingerprint isn't in ``known``."""
    accepted = partitioned.filter("status = 'accepted'")
    return accepted.join(known.select(F.col(fingerprint_column).alias("__fp")).distinct(), F.col("analysis.semantic_fingerprint") == F.col("__fp"), "left_anti")
