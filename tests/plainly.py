"""Formulas by plain loops over rows and assets, to hold the library against."""

import math

import numpy as np


def values(node, panel, groups=None):
    """The formula by plain loops over rows and assets; NaN where it has no value."""
    if node.tag == "field":
        return panel[node.name]
    if node.tag in ("number", "bool"):
        return np.full(next(iter(panel.values())).shape, float(node.value))
    x = [values(a, panel, groups) if a.tag != "group" else None for a in node.args]
    name = node.name
    if name == "greater":
        return np.where(np.isnan(x[0]), np.nan, x[0] > x[1])
    if name == "if_else":
        return np.where(np.isnan(x[0]), np.nan, np.where(x[0] == 1, x[1], x[2]))
    plain = {"negate": lambda: -x[0], "abs": lambda: np.abs(x[0]), "sign": lambda: np.sign(x[0]), "subtract": lambda: x[0] - x[1], "divide": lambda: x[0] / x[1], "add": lambda: sum(x[1:], x[0]), "multiply": lambda: math.prod(x[1:], start=x[0])}
    if name in plain:
        return plain[name]()
    if name == "clip":
        return np.clip(x[0], node.keyword("lower").value, node.keyword("upper").value)
    rows, assets = x[0].shape
    out = np.full(x[0].shape, np.nan)
    if name in ("rank", "group_rank", "zscore", "winsorize"):
        for t in range(rows):
            row = x[0][t]
            if name.endswith("rank"):
                for label in set(groups or [0]) if name == "group_rank" else [0]:
                    own = [a for a in range(assets) if not np.isnan(row[a]) and (name == "rank" or groups is None or groups[a] == label)]
                    for place, a in enumerate(sorted(own, key=lambda a: (row[a], a))):
                        out[t, a] = place / (len(own) - 1) if len(own) > 1 else 0.5
            else:
                if np.isnan(row).all():
                    continue
                mean, sd = np.nanmean(row), np.nanstd(row)
                out[t] = ((row - mean) / sd if sd > 1e-12 else row * 0.0) if name == "zscore" else np.clip(row, mean - node.keyword("std").value * sd, mean + node.keyword("std").value * sd)
        return out
    w = int(node.args[-1].value)
    for t in range(rows):
        for a in range(assets):
            if name in ("ts_delay", "ts_delta"):
                if t >= w:
                    out[t, a] = x[0][t - w, a] if name == "ts_delay" else x[0][t, a] - x[0][t - w, a]
                continue
            f = [y[max(0, t - w + 1) : t + 1, a] for y in x[:-1]]
            if len(f[0]) < w or any(np.isnan(y).any() for y in f):
                continue
            d = [y - y.mean() for y in f]
            steady = np.ptp(f[0]) < 1e-12
            alpha = 1 - 2 / (1 + w)
            out[t, a] = {
                "ts_sum": lambda: f[0].sum(), "ts_mean": lambda: f[0].mean(), "ts_min": lambda: f[0].min(), "ts_max": lambda: f[0].max(), "ts_median": lambda: np.sort(f[0])[(w - 1) // 2], "ts_std_dev": lambda: f[0].std(), "ts_var": lambda: f[0].var(ddof=1),
                "ts_mad": lambda: np.abs(d[0]).mean(), "ts_rank": lambda: ((f[0] <= f[0][-1]).sum() - 1) / max(w - 1, 1), "ts_zscore": lambda: 0.0 if steady else d[0][-1] / f[0].std(), "ts_skew": lambda: np.nan if steady else (d[0] ** 3).mean() / f[0].std() ** 3,
                "ts_kurt": lambda: np.nan if steady else (d[0] ** 4).mean() / f[0].var(ddof=1) ** 2 - 3, "ts_wma": lambda: (f[0] * np.arange(w)).sum() / sum(range(w)), "ts_ema": lambda: np.average(f[0], weights=[alpha ** (w - i) for i in range(w)]),
                "ts_cov": lambda: (d[0] * d[1]).sum() / (w - 1), "ts_corr": lambda: (d[0] * d[1]).sum() if min((y**2).sum() for y in d) < 1e-6 else (d[0] * d[1]).sum() / math.sqrt((d[0] ** 2).sum() * (d[1] ** 2).sum()),
            }[name]()
    return out
