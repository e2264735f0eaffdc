"""Elementwise operators and predicates as columns. Null propagates; IEEE values are kept."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def negate(x: Column) -> Column:
    return -x


def absolute(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    """1, -1 or 0; NaN gives 0, and so does a negative zero (F.signum would keep both)."""
    return F.when(x.isNull(), None).when(F.isnan(x), 0.0).when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def add(signals: list[Column], scalars: list[float]) -> Column:
    """Left fold from 0 over the signals in their order, then the scalars."""
    return reduce(operator.add, [*signals, *map(F.lit, scalars)], F.lit(0.0))


def multiply(signals: list[Column], scalars: list[float]) -> Column:
    """Left fold from 1 over the signals in their order, then the scalars."""
    return reduce(operator.mul, [*signals, *map(F.lit, scalars)], F.lit(1.0))


def clip(x: Column, lower: float, upper: float) -> Column:
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(lower)), F.lit(upper)))


def greater(x: Column, bound: float) -> Column:
    """Spark holds NaN to be above all numbers; here it is above none."""
    return F.when(F.isnan(x), False).otherwise(x > F.lit(bound))


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """A null condition gives null, where CASE alone would go on to the other branch."""
    return F.when(condition.isNull(), None).when(condition, yes).otherwise(no)
