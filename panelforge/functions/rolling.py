"""Row-based rolling operators of each asset, on a dense panel.

A window of w rows counts only if all its values are present. Operators of one sort order share one Window node,
whatever their lengths; plain aggregates are preferred. Weighted means are sums of lags; lists are built only where order
or rank inside a short window counts. Longer windows of both kinds are left to ``kernels``.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _by():
    return Window.partitionBy("ai").orderBy("t")


def _frame(w: int):
    return _by().rowsBetween(-(w - 1), 0)


def _full(x: Column, w: int, value: Column) -> Column:
    return F.when(F.count(x).over(_frame(w)) == w, value)


def _over(f):
    return lambda x, w: _full(x, w, f(x).over(_frame(w)))


def _values(x: Column, w: int) -> Column:
    return F.collect_list(x).over(_frame(w))


def delay(x: Column, d: int) -> Column:
    return F.lag(x, d).over(_by())


def delta(x: Column, d: int) -> Column:
    return x - F.lag(x, d).over(_by())


total = _over(F.sum)
mean = _over(F.avg)
std_dev = _over(F.stddev_pop)
variance = _over(F.var_samp)
skew = _over(F.skewness)
lowest = _over(F.min)


def highest(x: Column, w: int) -> Column:
    """The largest value; NaN is passed over unless all are NaN (F.max would return it)."""
    plain = F.max(F.when(~F.isnan(x), x)).over(_frame(w))
    return _full(x, w, F.coalesce(plain, F.lit(float("nan"))))


def zscore(x: Column, w: int) -> Column:
    sd = F.stddev_pop(x).over(_frame(w))
    return _full(x, w, F.when(sd == 0, 0.0).otherwise(F.try_divide(x - F.avg(x).over(_frame(w)), sd)))


def kurt(x: Column, w: int) -> Column:
    """Fourth central moment over the squared sample variance, less 3; null for a constant window."""
    return _full(x, w, (F.kurtosis(x).over(_frame(w)) + 3) * F.lit(((w - 1) / w) ** 2) - 3)


def median(x: Column, w: int) -> Column:
    """The lower of the two middle values."""
    return _full(x, w, F.get(F.sort_array(_values(x, w)), F.lit((w - 1) // 2)))


def mad(x: Column, w: int) -> Column:
    """Mean absolute deviation from the mean."""
    mu = F.avg(x).over(_frame(w))
    return _full(x, w, F.aggregate(_values(x, w), F.lit(0.0), lambda a, v: a + F.abs(v - mu)) / F.lit(float(w)))


def rank(x: Column, w: int) -> Column:
    """How many of the window are not above the current value, itself not counted, over w - 1."""
    return _full(x, w, (F.size(F.filter(_values(x, w), lambda v: v <= x)) - 1) / F.lit(float(max(w - 1, 1))))


def weighted(x: Column, weights: list[float]) -> Column:
    """Mean weighted oldest first."""
    w = len(weights)
    total = F.lit(0.0)
    for i, c in enumerate(weights):
        if c:
            total = total + F.lit(float(c)) * (F.lag(x, w - 1 - i).over(_by()) if i < w - 1 else x)
    return _full(x, w, total / F.lit(float(sum(weights))))


def wma(x: Column, w: int) -> Column:
    """Weights 0 (oldest) to w - 1."""
    return weighted(x, list(range(w)))


def ema(x: Column, w: int) -> Column:
    """Weights alpha^(w - i) with alpha = 1 - 2 / (1 + w), over the window alone."""
    alpha = 1 - 2 / (1 + w)
    return weighted(x, [alpha ** (w - i) for i in range(w)])


def decay(x: Column, n: int) -> Column:
    """Linear decay: weight n for the current value down to 1; 0 leaves the signal as it is."""
    return weighted(x, list(range(1, n + 1))) if n else x


def _pairs(a: Column, b: Column) -> tuple[Column, Column]:
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def cov(a: Column, b: Column, w: int) -> Column:
    x, y = _pairs(a, b)
    return _full(x, w, F.covar_samp(x, y).over(_frame(w)))


def corr(a: Column, b: Column, w: int) -> Column:
    """Pearson; where a sum of squares is below 1e-6, the sum of products itself."""
    x, y = _pairs(a, b)
    f = _frame(w)
    products = F.covar_pop(x, y).over(f)
    small = (F.var_pop(x).over(f) * w < 1e-6) | (F.var_pop(y).over(f) * w < 1e-6)
    return _full(x, w, F.when(small, products * w).otherwise(F.try_divide(products, F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f))))


ROLLING = {
    "ts_delay": delay, "ts_delta": delta, "ts_sum": total, "ts_mean": mean, "ts_std_dev": std_dev, "ts_zscore": zscore, "ts_var": variance, "ts_skew": skew, "ts_kurt": kurt,
    "ts_min": lowest, "ts_max": highest, "ts_median": median, "ts_mad": mad, "ts_rank": rank, "ts_wma": wma, "ts_ema": ema,
}
PAIRED = {"ts_cov": cov, "ts_corr": corr}
