"""From signals to positions, causal returns and metrics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.expr.ast import Node
from panelforge.expr.canonical import canonical, fingerprint
from panelforge.expr.catalog import Catalog
from panelforge.expr.parser import parse
from panelforge.operators.panel import DatasetError, Panel
from panelforge.plans.compiler import SUPPORTED, compile_signals
from panelforge.plans.lineage import cut

ASSUMPTIONS = (
    "windows over time use the current and earlier rows only",
    "root decay weights the current and earlier rows linearly",
    "the return over a horizon is the sum of the realized returns of its rows",
    "pairs without a signal or target are left out, nothing is imputed",
    "cross-sectional ranks settle ties by asset order",
    "positions are demeaned, scaled to unit gross and, if asked, truncated with redistribution",
    "costs are turnover times cost_bps / 10000",
    "overall evidence does not reset positions at the borders of splits",
    "proxy metrics are local estimates",
)

#: Signals evaluated in one plan.
AT_ONCE = 40


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class EvaluationConfig:
    """Rows of the panel: signals count from ``evaluation_start``; train ends before ``train_end``, validation before ``validation_end``."""

    train_end: int
    validation_end: int
    evaluation_start: int = 0
    horizon: int = 1
    cost_bps: float = 0.0
    annualization_rows: int | None = None
    signal_decay: int = 0
    truncation: float = 0.0
    include_daily: bool = False
    proxy: bool = False

    def checked(self, rows: int) -> EvaluationConfig:
        if self.horizon < 1:
            raise ConfigError("the horizon must be positive")
        if not self.evaluation_start < self.train_end < self.validation_end < rows or self.evaluation_start < 0:
            raise ConfigError("splits must follow one another within the panel")
        if any(b - a <= self.horizon for _, a, b in self.splits(rows)[:3]):
            raise ConfigError("each split must be longer than the horizon")
        if not 0 <= self.signal_decay <= 512:
            raise ConfigError("signal_decay must be between 0 and 512")
        if not 0 <= self.truncation <= 1 or math.copysign(1, self.truncation) < 0:
            raise ConfigError("truncation must be between 0 and 1")
        if not (math.isfinite(self.cost_bps) and self.cost_bps >= 0):
            raise ConfigError("cost_bps must be finite and not negative")
        if self.proxy and not self.annualization_rows:
            raise ConfigError("proxy metrics need annualization_rows")
        return self

    def splits(self, rows: int) -> list[tuple[str, int, int]]:
        return [
            ("train", self.evaluation_start, self.train_end), ("validation", self.train_end, self.validation_end), ("holdout", self.validation_end, rows),
            ("overall", self.evaluation_start, rows),
        ]


def future_return(returns: Column, horizon: int) -> Column:
    """The sum over the next ``horizon`` rows of the asset, null if any of them is missing."""
    ahead = Window.partitionBy("ai").orderBy("t").rowsBetween(1, horizon)
    return F.when(F.count(returns).over(ahead) == horizon, F.sum(returns).over(ahead))


def with_positions(df: DataFrame, keys: list[str], signal: str, truncation: float = 0.0, out: str = "position") -> DataFrame:
    """Demeaned over ``keys`` (one cross-section), scaled to unit gross, null where the signal is or the gross is 0.

    With a cap: the k largest are set to the cap and the rest scaled up by one factor, k being the smallest number for
    which nothing else is above it. In descending order of size that is the first k with a[k+1] (1 - k cap) / S(k) <= cap,
    S(k) the sum of all after the k-th, so a running sum finds it without iterating. If the cap is too low for unit gross,
    all are null.
    """
    w = Window.partitionBy(*keys)
    x = F.col(signal)
    centred = df.withColumn("__c", x - F.avg(x).over(w))
    gross = F.sum(F.abs("__c")).over(w)
    df = centred.withColumn(out, F.when(gross == 0, None).otherwise(F.try_divide("__c", gross))).drop("__c")
    if not truncation:
        return df
    size = F.abs(out)
    order = Window.partitionBy(*keys).orderBy(size.desc_nulls_last(), "ai")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"__k": F.row_number().over(order) - 1, "__before": F.coalesce(F.sum(size).over(upto) - size, F.lit(0.0)), "__n": F.count(out).over(w), "__all": F.sum(size).over(w), "__a": size})
    # of the row at place k (from 0): its size is a[k+1], what is left from it on is S(k)
    rest = F.col("__all") - F.col("__before")
    room = 1 - F.col("__k") * F.lit(truncation)
    fits = F.col("__a").isNotNull() & (F.col("__a") * room <= F.lit(truncation) * rest * (1 + 1e-12))
    df = df.withColumn("__fit", F.min(F.when(fits, F.col("__k"))).over(w))
    df = df.withColumn("__rest", F.max(F.when(F.col("__k") == F.col("__fit"), rest)).over(w))
    capped = F.col("__fit").isNull() | (F.col("__k") < F.col("__fit"))
    scaled = F.when(F.col("__rest") == 0, F.col(out)).otherwise(F.try_divide(F.col(out) * (1 - F.col("__fit") * F.lit(truncation)), "__rest"))
    limited = F.when(capped, F.when(F.col(out) < 0, -truncation).otherwise(truncation)).otherwise(scaled)
    result = F.when(F.col(out).isNull() | (F.col("__n") * F.lit(truncation) < 1 - 1e-12), None).when(F.col("__fit") == 0, F.col(out)).otherwise(limited)
    return df.withColumn(out, result).drop("__k", "__before", "__n", "__all", "__a", "__fit", "__rest")


def _long(signals: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("formula"), F.col(f"`{n}`").alias("x")) for n in names)))
    return signals.select("t", "ts", "ai", "outcome", pairs.alias("p")).select("t", "ts", "ai", "outcome", "p.formula", "p.x")


@dataclass(frozen=True)
class Evidence:
    """``metrics``: one row per (formula, split); ``daily``: one row per formula and active row of the whole period."""

    metrics: DataFrame
    daily: DataFrame
    pairs: DataFrame


def evidence(panel: Panel, formulas: Mapping[str, Node], config: EvaluationConfig) -> Evidence:
    """Evidence of several formulas in one plan: the formulas share their subtrees, then every step is by formula.

    A signal at row t stands against the sum of the realized returns of the next ``horizon`` rows; all target rows lie
    inside the split. A row is active if any asset has both a position and an outcome. Turnover is against the positions
    of the previous active row of the split, nothing before its first. Correlation pools all pairs of signal and outcome.
    """
    config = config.checked(panel.rows)
    signals = compile_signals(panel, formulas, config.signal_decay)
    signals = signals.withColumn("outcome", future_return(F.col("realized_returns"), config.horizon))
    rows = cut(with_positions(_long(signals, list(formulas)), ["formula", "t"], "x", config.truncation))  # for correlations and days
    splits = config.splits(panel.rows)
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("split"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in splits)))
    within = rows.select("*", named.alias("s")).filter((F.col("t") >= F.col("s.a")) & (F.col("t") < F.col("s.b") - config.horizon)).withColumn("split", F.col("s.split")).drop("s")

    both = F.col("x").isNotNull() & F.col("outcome").isNotNull()
    x, o = F.when(both, F.col("x")), F.when(both, F.col("outcome"))
    denominator = F.stddev_pop(x) * F.stddev_pop(o)
    pairs = within.groupBy("formula", "split").agg(F.count(x).alias("observations"), F.when((F.count(x) >= 2) & (denominator > 0), F.try_divide(F.covar_pop(x, o), denominator)).alias("pearson"))

    active = within.withColumn("__n", F.count(F.col("position") * F.col("outcome")).over(Window.partitionBy("formula", "split", "t"))).filter("__n > 0")
    held = F.coalesce("position", F.lit(0.0))
    before = F.coalesce(F.lag(held).over(Window.partitionBy("formula", "split", "ai").orderBy("t")), F.lit(0.0))
    moved = active.withColumn("__moved", F.abs(held - before))
    daily = moved.groupBy("formula", "split", "t", "ts").agg(F.sum(F.col("position") * F.col("outcome")).alias("gross"), F.sum("__moved").alias("turnover"))
    daily = daily.withColumn("net", F.col("gross") - F.col("turnover") * F.lit(config.cost_bps / 10000.0))
    return Evidence(_metrics(panel, formulas, config, daily, pairs), _daily(panel, config, daily), pairs)


def _daily(panel: Panel, config: EvaluationConfig, daily: DataFrame) -> DataFrame:
    # a dense panel has every time in the rows of its first asset
    ends = panel.df.filter("ai = 0").select((F.col("t") - config.horizon).alias("t"), F.col("ts").alias("target_ts"))
    rows = daily.filter("split = 'overall'").join(ends, "t")
    return rows.select("formula", F.col("t").alias("signal_row"), (F.col("t") + config.horizon).alias("target_end_row"), F.col("ts").alias("signal_timestamp"), F.col("target_ts").alias("target_timestamp"), "gross", "net", "turnover")


def drawdown(value: str) -> Column:
    """Running peak (at least 0) less running sum of ``value``, to be maximised over (formula, split)."""
    upto = Window.partitionBy("formula", "split").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(upto)


def _metrics(panel: Panel, formulas: Mapping[str, Node], config: EvaluationConfig, daily: DataFrame, pairs: DataFrame) -> DataFrame:
    upto = Window.partitionBy("formula", "split").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = daily.withColumns({f"__sum_{v}": drawdown(v) for v in ("gross", "net")})
    d = d.withColumns({f"__down_{v}": F.greatest(F.max(f"__sum_{v}").over(upto), F.lit(0.0)) - F.col(f"__sum_{v}") for v in ("gross", "net")})
    a = config.annualization_rows

    def sharpe(v: str) -> Column:
        spread = F.stddev_pop(v)
        return F.when((F.count(v) >= 2) & (spread > 0), F.try_divide(F.avg(v), spread) * F.sqrt(F.lit(float(a)))) if a else F.lit(None).cast("double")

    aggs = [F.avg(v).alias(f"mean_{v}") for v in ("gross", "net", "turnover")]
    aggs += [sharpe(v).alias(f"{v}_sharpe") for v in ("gross", "net")] + [F.max(f"__down_{v}").alias(f"{v}_drawdown") for v in ("gross", "net")]
    per = d.groupBy("formula", "split").agg(*aggs)
    frame = panel.df.sparkSession.createDataFrame([(n, s, x, y) for n in formulas for s, x, y in config.splits(panel.rows)], "formula string, split string, start_row int, end_row int")
    out = frame.join(pairs, ["formula", "split"], "left").join(per, ["formula", "split"], "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
    for v in ("gross", "net"):
        out = out.withColumn(f"annual_{v}", F.col(f"mean_{v}") * a if a else F.lit(None).cast("double"))
    if config.proxy:
        returns, turnover = F.col("mean_gross") * a * 2, F.col("mean_turnover")
        out = out.withColumns({
            "proxy_returns": returns, "proxy_drawdown": F.col("gross_drawdown") * 2, "proxy_margin": F.when(turnover > 0, F.try_divide(F.col("mean_gross"), turnover)),
            "proxy_fitness": F.col("gross_sharpe") * F.sqrt(F.try_divide(F.abs(returns), F.greatest(turnover, F.lit(0.125)))),
        })
    return out


def evaluate(text: str, panel: Panel, config: EvaluationConfig, catalog: Catalog | None = None) -> dict:
    """One formula's evidence as a plain record, for files and reports."""
    node = parse(text, catalog)
    e = evidence(panel, {"formula": node}, config)
    metrics = {r["split"]: {k: v for k, v in r.asDict().items() if k not in ("formula", "split")} for r in e.metrics.collect()}  # four rows
    record = {
        "schema": 1, "dataset_id": panel.dataset_id, "source_label": panel.source_label, "expression": canonical(node), "expression_fingerprint": fingerprint(node), "horizon": config.horizon,
        "evaluation_start": config.evaluation_start, "signal_decay": config.signal_decay, "truncation": config.truncation, "cost_bps": config.cost_bps, "annualization_rows": config.annualization_rows,
        "preprocessing": list(panel.notes), "assumptions": list(ASSUMPTIONS), "overall": metrics["overall"], "splits": {s: metrics[s] for s in ("train", "validation", "holdout")},
    }
    if config.include_daily:
        record["daily"] = [r.asDict() for r in e.daily.drop("formula").orderBy("signal_row").collect()]  # one row per time
    return record


def evaluate_batch(texts: Iterable[str], panel: Panel, config: EvaluationConfig, catalog: Catalog | None = None) -> list[dict]:
    """A record for each text in its order: succeeded with metrics, or failed with an error; none stops the others."""
    records: list[dict] = []
    good: dict[str, Node] = {}
    for i, text in enumerate(texts):
        try:
            node = parse(text, catalog)
            for n in node.walk():
                if n.tag == "field" and n.name not in panel.fields:
                    raise DatasetError(f"the dataset lacks field `{n.name}`")
                if n.tag == "group" and n.name not in panel.groups:
                    raise DatasetError(f"the dataset lacks group `{n.name}`")
                if n.tag == "call" and n.name not in SUPPORTED:
                    raise DatasetError(f"no evaluation of operator `{n.name}`")
            good[str(i)] = node
            records.append({"position": i, "expression": canonical(node), "status": "succeeded", "splits": {}})
        except ValueError as e:
            records.append({"position": i, "expression": text, "status": "failed", "error": str(e)})
    names = list(good)
    for a in range(0, len(names), AT_ONCE):
        for r in evidence(panel, {n: good[n] for n in names[a : a + AT_ONCE]}, config).metrics.collect():  # four rows a formula
            records[int(r["formula"])]["splits"][r["split"]] = {k: v for k, v in r.asDict().items() if k not in ("formula", "split")}
    return records
