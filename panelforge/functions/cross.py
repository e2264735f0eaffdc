"""Cross-sectional operators: over all assets of one time."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rank(x: Column, *within: str) -> Column:
    """Ordinal rank from 0 to 1 of the values present, ties by asset; alone 0.5. ``within``: further partition columns.

    -0.0 comes before 0.0, as in a total order of doubles.
    """
    keys = ("t", *within)
    negative_zero = F.when((x == 0) & (x.cast("string") == "-0.0"), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_last(), negative_zero, "ai")) - 1
    n = F.count(x).over(Window.partitionBy(*keys))
    return F.when(x.isNotNull(), F.when(n == 1, 0.5).otherwise(F.try_divide(place.cast("double"), n - 1)))


def zscore(x: Column) -> Column:
    w = Window.partitionBy("t")
    sd = F.stddev_pop(x).over(w)
    return F.when(x.isNotNull(), F.when(sd == 0, 0.0).otherwise(F.try_divide(x - F.avg(x).over(w), sd)))


def winsorize(x: Column, std: float) -> Column:
    """Clamped to the mean plus or minus ``std`` population deviations; null where these aren't numbers."""
    w = Window.partitionBy("t")
    mu, sd = F.avg(x).over(w), F.stddev_pop(x).over(w)
    usable = x.isNotNull() & ~F.isnan(mu) & ~F.isnan(sd)
    return F.when(usable, F.least(F.greatest(x, mu - F.lit(std) * sd), mu + F.lit(std) * sd))
