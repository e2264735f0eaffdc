"""Problem 7: totals and averages over trailing calendar periods, idle days included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.plans.current import latest
from panelforge.plans.lineage import cut


def day_of(ts: Column, unit: Column) -> Column:
    """The UTC date of ``ts`` given as yyyymmdd, epoch_s or epoch_ms; null for another unit or an impossible date."""
    digits = F.when((ts >= 10101) & (ts <= 99991231), F.lpad(ts.cast("string"), 8, "0"))
    since = F.when(unit == "epoch_s", F.floor(ts / F.lit(86400.0))).when(unit == "epoch_ms", F.floor(ts / F.lit(86400000.0)))
    seconds = F.when(F.abs(since) < 2_000_000, F.date_add(F.lit("1970-01-01").cast("date"), since.cast("int")))
    return F.when(unit == "yyyymmdd", F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")).otherwise(seconds)


def rolling_totals(daily: DataFrame, calendar: DataFrame, entity: list[str], day: str, values: list[str], periods: list[int], means: bool = True) -> DataFrame:
    """entity, day, day_index, and for each value v and period p ``v_total_p``, ``v_mean_p``, of every calendar day.

    ``daily``: at most one row per entity and day (a date), with totals; ``calendar``: one row per entity with
    ``first_day`` and ``last_day``. Every day from the first to the last comes out, with day_index 1 for the first. A
    total is over the last p calendar days, that day included; days without a row and null values add 0. A mean divides
    by the days of the period that lie in the calendar: min(p, day_index). Days of ``daily`` outside the calendar don't
    count; entities whose calendar is null or ends before it begins have no rows; null entities take no part.

    Range join: every day's totals are entered in the coarse bucket (as wide as the longest period) of their date and
    in the next, so each calendar day meets exactly the totals of its own and the bucket before by an equality, then by
    its bounds. A bucket of an entity holds at most two periods of totals, so no entity is too large for a task. The
    last aggregation groups by the join's own keys and so needs no further shuffle.
    """
    if not periods or any(p < 1 for p in periods):
        raise ValueError("periods must be positive")
    longest = max(periods)
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    bucket = lambda d: F.floor(d / F.lit(float(longest))).cast("int")
    bounds = calendar.filter(F.col("first_day") <= F.col("last_day")).select(*entity, number(F.col("first_day")).alias("lo"), number(F.col("last_day")).alias("hi"))
    days = bounds.select(*entity, "lo", F.explode(F.sequence("lo", "hi")).alias("d")).withColumn("bucket", bucket(F.col("d")))
    totals = daily.select(*entity, number(F.col(day)).alias("t"), *values)
    entered = totals.select(*entity, "t", *values, F.explode(F.array(bucket(F.col("t")), bucket(F.col("t")) + 1)).alias("bucket"))
    d, t = days.alias("d"), entered.alias("t")
    within = (F.col("t.t") <= F.col("d.d")) & (F.col("t.t") > F.col("d.d") - longest) & (F.col("t.t") >= F.col("d.lo"))
    keys = [F.col(f"d.{e}") == F.col(f"t.{e}") for e in entity]
    on = F.col("d.bucket") == F.col("t.bucket")
    for k in keys:
        on = on & k
    joined = d.join(t, on & within, "left")
    aggs = []
    for v in values:
        for p in periods:
            inside = F.col(f"t.{v}") if p == longest else F.when(F.col("t.t") > F.col("d.d") - p, F.col(f"t.{v}"))
            aggs.append(F.coalesce(F.sum(inside), F.lit(0.0)).alias(f"{v}_total_{p}"))
    out = joined.groupBy(*(F.col(f"d.{e}").alias(e) for e in entity), F.col("d.bucket").alias("bucket"), F.col("d.d").alias("d"), F.col("d.lo").alias("lo")).agg(*aggs)
    index = F.col("d") - F.col("lo") + 1
    cols = [F.col(f"{v}_total_{p}") for v in values for p in periods]
    if means:
        cols += [(F.col(f"{v}_total_{p}") / F.least(F.lit(p), index)).alias(f"{v}_mean_{p}") for v in values for p in periods]
    return out.select(*entity, F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).alias(day), index.alias("day_index"), *cols)


def _clean(c: str) -> Column:
    x = F.col(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def panel_daily(rows: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily totals (dataset_id, asset, day, fld_volume, realized_returns) and the calendar of each asset.

    Only the current row of each (dataset_id, asset, ts, bar_no) counts: latest ingested_at, then highest row_id. Null,
    non-finite and negative volumes, and null and non-finite returns, count as 0. The calendar runs from the asset's
    first day with a row to its dataset's last_day. Rows with a null key, an unknown dataset or an impossible time are
    left out. Versions and totals are both reduced in each task before their shuffle, so copies of one row, or one day of
    one asset, may be any share of the rows.
    """
    known = datasets.select("dataset_id", F.col("ts_unit").alias("unit"), F.try_to_timestamp(F.col("last_day").cast("string"), F.lit("yyyyMMdd")).cast("date").alias("last_day")).dropDuplicates(["dataset_id"])
    narrow = rows.select("dataset_id", "asset", "ts", "bar_no", "row_id", "ingested_at", "fld_volume", "realized_returns").join(known, "dataset_id")
    dated = narrow.withColumn("day", day_of(F.col("ts"), F.col("unit"))).filter(F.col("day").isNotNull())
    now = latest(dated, ["dataset_id", "asset", "day", "ts", "bar_no"], [F.col("ingested_at").desc_nulls_last(), F.col("row_id").desc_nulls_last()])
    volume = F.greatest(_clean("fld_volume"), F.lit(0.0))
    daily = now.groupBy("dataset_id", "asset", "day").agg(F.sum(volume).alias("fld_volume"), F.sum(_clean("realized_returns")).alias("realized_returns"), F.min("last_day").alias("last_day"))
    daily = cut(daily)  # for the calendar and the totals
    calendar = daily.groupBy("dataset_id", "asset").agg(F.min("day").alias("first_day"), F.min("last_day").alias("last_day"))
    return daily.drop("last_day"), calendar


def panel_totals(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """dataset_id, asset, day, day_index, totals and means of volume and returns over 7 and 30 days."""
    daily, calendar = panel_daily(rows, datasets)
    return rolling_totals(daily, calendar, ["dataset_id", "asset"], "day", ["fld_volume", "realized_returns"], [7, 30])


def day_number(c: Column) -> Column:
    return F.year(c).cast("long") * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def volume_bursts(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """dataset_id, asset, day_no where the volume of 7 days is more than 0.7 of that of 30, from the 30th day on.

    Compared as 10 x v7 > 7 x v30: for whole volumes sums and products are exact (up to 2^53), so an equality is none in
    any order of tasks; 0.7 itself has no exact double.
    """
    daily, calendar = panel_daily(rows, datasets)
    totals = rolling_totals(daily.drop("realized_returns"), calendar, ["dataset_id", "asset"], "day", ["fld_volume"], [7, 30], means=False)
    burst = (F.col("day_index") >= 30) & (F.lit(10.0) * F.col("fld_volume_total_7") > F.lit(7.0) * F.col("fld_volume_total_30"))
    return totals.filter(burst).select("dataset_id", "asset", day_number(F.col("day")).alias("day_no"))
