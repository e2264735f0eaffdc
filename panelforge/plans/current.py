"""The row that counts among several versions of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RN = "__pf_version"


def latest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row of every key: the first by ``by`` (give descending columns), nulls last.

    Rows with a null in a key part have no identity and are dropped. Row number 1 lets Spark keep one row of a key in
    each task before the shuffle, so a key that holds a third of all rows is no burden to one task.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.filter(whole).withColumn(_RN, F.row_number().over(w)).filter(F.col(_RN) == 1).drop(_RN)


def tidy(c: Column | str) -> Column:
    """Trimmed of all white space and lower-cased."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def current_candidates(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The current row of each candidate_id (latest written_at), with the named columns.

    Equal written_at: the higher structural_score, then the greater fingerprint, counts. Rows without an id are dropped.
    """
    narrow = df.select("candidate_id", "written_at", F.col("structural_score").alias("__pf_tie1"), F.col("fingerprint").alias("__pf_tie2"), *(c.alias(n) for n, c in columns.items() if n != "candidate_id"))
    by = [F.col("written_at").desc_nulls_last(), F.col("__pf_tie1").desc_nulls_last(), F.col("__pf_tie2").desc_nulls_last()]
    return latest(narrow, ["candidate_id"], by).drop("written_at", "__pf_tie1", "__pf_tie2")
