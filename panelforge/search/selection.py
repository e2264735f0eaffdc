"""Selections from ordered candidates: caps per field set, round robins over buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.numbering import numbered


def field_diverse(df: DataFrame, order: list[str], fields: str, limit: int, most: int) -> DataFrame:
    """``df`` with status selected, deferred or remaining: at most ``most`` rows of each field set, ``limit`` in all.

    Rows come in ascending ``order`` (distinct values). A row beyond its set's cap is deferred; once ``limit`` rows are
    selected, all later ones remain, over the cap or not. Null field sets are one set.
    """
    if limit < 0 or most < 1:
        raise ValueError("limit must not be negative and the cap at least 1")
    within = Window.partitionBy(fields).orderBy(*order)
    ranked = df.withColumn("__set", F.row_number().over(within))
    # only the first ``limit`` rows under the cap can be selected
    chosen = ranked.filter(F.col("__set") <= most).select(F.struct(*order).alias("__k")).orderBy("__k").limit(limit)
    r = chosen.agg(F.count("*").alias("n"), F.max("__k").alias("last")).first()
    full = r["n"] == limit
    if limit == 0:
        return ranked.drop("__set").withColumn("status", F.lit("remaining"))
    key = F.struct(*order)
    kinds = dict(df.dtypes)
    last = F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, r["last"]))) if r["last"] is not None else None
    beyond = key > last if full and last is not None else F.lit(False)
    return ranked.withColumn("status", F.when(beyond, "remaining").when(F.col("__set") > most, "deferred").otherwise("selected")).drop("__set")


def node_bucket(nodes: Column) -> Column:
    """0 for up to 5 nodes, then up to 12, 24, 48, 96, and 5 for more."""
    out = F.lit(5)
    for i, most in reversed(list(enumerate((5, 12, 24, 48, 96)))):
        out = F.when(nodes <= most, i).otherwise(out)
    return out


def round_robin(df: DataFrame, bucket: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows taken in turns from the buckets, each in ``order``; ``place`` is the turn, from 0.

    Buckets take their turns by the order of their best rows. ``order`` must be total.
    """
    w = Window.partitionBy(*bucket).orderBy(*order)
    ranked = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit)
    first = ranked.filter("__rn = 1").orderBy(*order).limit(limit)  # more buckets than places get no turn
    heads = first.withColumn("__head", F.row_number().over(Window.orderBy(*order))).select(*(F.col(b).alias(f"__b{i}") for i, b in enumerate(bucket)), "__head")  # at most ``limit`` rows
    on = F.lit(True)
    for i, b in enumerate(bucket):
        on = on & F.col(b).eqNullSafe(F.col(f"__b{i}"))
    turns = ranked.join(heads, on).withColumn("__turn", F.struct("__rn", "__head")).orderBy("__turn").limit(limit)
    return numbered(turns, "__turn", "place").withColumn("place", F.col("place").cast("int")).drop("__rn", "__head", "__turn", *(f"__b{i}" for i in range(len(bucket))))


def retention_column(d: str) -> Column:
    """``engine.retention_value`` of a descriptor struct, within the JVM."""
    from panelforge.search.engine import RETENTION, RETENTION_FLAGS

    total = F.lit(0)
    for n, w in RETENTION.items():
        field = F.col(f"{d}.{n}")
        values = F.map_keys(field) if n in ("operator_histogram", "window_buckets") else F.array_distinct(F.filter(field, lambda v: v.isNotNull()))
        total = total + F.lit(w) * F.coalesce(F.size(values), F.lit(0))
    for n, w in RETENTION_FLAGS.items():
        total = total + F.when(F.col(f"{d}.{n}"), F.lit(w)).otherwise(0)
    return total


def bounded_elites(df: DataFrame, bucket: list[str], worth: list[Column], limit: int) -> DataFrame:
    """The ``limit`` rows that come first when the buckets, in the order of their keys, take turns; each gives its rows in the order of ``worth`` (total).

    A bucket keeps at most ``limit`` rows in each task before the shuffle, so it may hold any share of the rows.
    """
    w = Window.partitionBy(*bucket).orderBy(*worth)
    ranked = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit)
    return ranked.withColumn("__turn", F.struct("__rn", *bucket)).orderBy("__turn").limit(limit).drop("__rn", "__turn")
