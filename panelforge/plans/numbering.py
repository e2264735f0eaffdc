"""Consecutive numbers in a global order, without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.lineage import cut

#: Copies of a row of each group that its rows are joined to, so that a large group is joined by as many tasks.
COPIES = 16


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """``numbered_counted`` without the number of rows."""
    return numbered_counted(df, order, out)[0]


def numbered_counted(df: DataFrame, order: str, out: str) -> tuple[DataFrame, int]:
    """``df`` with ``out``: 0, 1, 2, ... in ascending order of the column, whose values must be distinct; and how many rows there are.

    A range-partitioned sort gives each row its place in its partition; the number of rows of each partition, one number
    each, is summed up over those before.
    """
    placed = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__pf_id", F.monotonically_increasing_id()))
    part = F.shiftright("__pf_id", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets, "__pf_part long, __pf_before long")
    joined = placed.withColumn("__pf_part", part).join(F.broadcast(table), "__pf_part")  # one row a partition
    local = F.col("__pf_id") - F.shiftleft(F.col("__pf_part"), 33)
    return joined.withColumn(out, (local + F.col("__pf_before")).cast("long")).drop("__pf_id", "__pf_part", "__pf_before"), before


def running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before, in ascending order of the column (distinct values).

    Rows are range-partitioned, summed up within each partition, and given the total of the partitions before.
    """
    placed = cut(df.repartitionByRange(order).withColumn("__pf_part", F.spark_partition_id()))
    totals = sorted((r["p"], r["n"]) for r in placed.groupBy(F.col("__pf_part").alias("p")).agg(F.sum(value).alias("n")).collect())  # one row a partition
    before, offsets = 0, []
    for p, n in totals:
        offsets.append((p, before))
        before += n or 0
    table = df.sparkSession.createDataFrame(offsets, f"__pf_part int, __pf_before {dict(df.dtypes)[value]}")
    within = Window.partitionBy("__pf_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(F.broadcast(table), "__pf_part").withColumn(out, F.col(out) + F.col("__pf_before")).drop("__pf_part", "__pf_before")  # one row a partition


def numbered_within(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... within each value of the column ``group`` in a total ``order``.

    One range-partitioned sort numbers all rows, and the first number of each group is taken off, so a group of any size
    is sorted by many tasks. The groups' first numbers are joined back, spread over a few copies.
    """
    rows = numbered(df.withColumn("__pf_key", F.struct(F.col(group).alias("g"), *(c.alias(f"o{i}") for i, c in enumerate(order)))), "__pf_key", "__pf_no").drop("__pf_key")
    rows = cut(rows)
    first = rows.groupBy(F.col(group).alias("__pf_g")).agg(F.min("__pf_no").alias("__pf_first")).withColumn("__pf_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    spread = rows.withColumn("__pf_copy", F.pmod("__pf_no", F.lit(COPIES)))
    joined = spread.join(first, F.col(group).eqNullSafe(F.col("__pf_g")) & (spread["__pf_copy"] == first["__pf_copy"]))
    return joined.select(*(F.col(c) for c in df.columns if c != out), (F.col("__pf_no") - F.col("__pf_first")).alias(out))


def placed_within(table: DataFrame, group: str, order: dict[str, Column], out: str, rows: int = 2**17) -> DataFrame:
    """``table`` with ``out``: 0, 1, 2, ... within each value of the int column ``group`` in a total ascending order of columns without nulls.

    ``table`` must give the same rows whenever it is read. A sample of each group gives keys at which it is cut into parts
    of about ``rows``; parts are counted, then each is moved once and sorted by itself, so nothing else is kept. Whatever
    the sample, the numbers are the same.
    """
    spark, keys = table.sparkSession, list(order)
    key = F.struct(*(c.alias(n) for n, c in order.items()))
    kinds = dict(table.select(*(c.alias(n) for n, c in order.items())).dtypes)
    every = max(1, rows // 64)
    some: dict[int, list[tuple]] = {}
    for r in table.filter(F.pmod(F.xxhash64(group, key), F.lit(every)) == 0).select(group, key.alias("k")).collect():  # 64 rows a part
        some.setdefault(r[group], []).append(tuple(r["k"]))
    cuts = [(g, c) for g, v in some.items() if (c := sorted(v)[64::64])]
    if not cuts:  # each group is one part
        w = Window.partitionBy(group).orderBy(*order.values())
        return table.repartition(group).withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    cut_at = spark.createDataFrame(cuts, f"{group} int, __pf_cuts array<struct<{', '.join(f'{n}: {kinds[n]}' for n in keys)}>>")
    part = F.size(F.filter("__pf_cuts", lambda c: c <= key))
    parted = table.join(F.broadcast(cut_at), group, "left").withColumn("__pf_part", F.when(F.col("__pf_cuts").isNull(), 0).otherwise(part)).drop("__pf_cuts")
    before, offsets, last = 0, [], None
    for g, p, n in sorted((r[group], r["__pf_part"], r["n"]) for r in parted.groupBy(group, "__pf_part").agg(F.count("*").alias("n")).collect()):  # one row a part
        before = before if g == last else 0
        offsets.append((g, p, before))
        before, last = before + n, g
    known = F.broadcast(spark.createDataFrame(offsets, f"{group} int, __pf_part int, __pf_before long"))  # one row a part
    w = Window.partitionBy(group, "__pf_part").orderBy(*order.values())
    # moved before the keys are made, so that these don't travel
    return parted.repartition(group, "__pf_part").withColumn("__pf_no", F.row_number().over(w)).join(known, [group, "__pf_part"]).withColumn(out, F.col("__pf_no") - 1 + F.col("__pf_before")).drop("__pf_no", "__pf_part", "__pf_before")
