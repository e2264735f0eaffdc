import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from plainly import values
from pyspark.sql import functions as F

from panelforge.core import rolling as calendar
from panelforge.expr.parser import parse
from panelforge.operators import evaluation
from panelforge.operators.panel import DatasetError, densified
from panelforge.plans.compiler import compile_signals
from panelforge.plans.current import latest
from panelforge.plans.numbering import numbered
from panelforge.sources import panels, universe


def noise(seed, rows=14, assets=3, gaps=0.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, assets)) * 8, 3)
    x[rng.random(x.shape) < gaps] = np.nan
    return x


def document(groups=("one", "two", "one"), **fields):
    shape = next(iter(fields.values())).shape
    flat = lambda x: {"values": [None if np.isnan(v) else float(v) for v in np.asarray(x).ravel()]}
    return json.dumps({
        "schema": 1, "dataset_id": "d", "source_label": "s", "timestamps": [5 * i for i in range(shape[0])], "assets": [f"a{i}" for i in range(shape[1])], "fields": {k: flat(v) for k, v in fields.items()},
        "realized_returns": flat(np.zeros(shape)), "groups": {"sector": list(groups)[: shape[1]]},
    })


FORMULAS = [
    "abs(close)", "negate(close)", "sign(close)", "subtract(close, volume)", "divide(close, 4)", "add(close, volume, open)", "multiply(close, 3, volume)", "clip(close, lower=-2, upper=5)", "winsorize(close, std=0.7)", "rank(close)", "zscore(close)",
    'group_rank(close, group("sector"))', "if_else(greater(close, 1), open, volume)", "if_else(true, open, volume)", "if_else(false, open, volume)", "ts_delay(close, 3)", "ts_delta(close, 2)",
    *(f"{n}(close, {w})" for n in ("ts_sum", "ts_mean", "ts_std_dev", "ts_zscore", "ts_var", "ts_skew", "ts_kurt", "ts_min", "ts_max", "ts_median", "ts_mad", "ts_rank", "ts_wma", "ts_ema") for w in (3, 4)),
    "ts_cov(close, volume, 4)", "ts_corr(close, volume, 5)", "rank(ts_median(zscore(close), 3))", "ts_wma(ts_rank(close, 3), 2)",
]


@pytest.mark.parametrize("gaps", [0.0, 0.15])
def test_formulas_against_plain_loops(spark, gaps):
    x = {k: noise(i + 7, gaps=gaps if k == "close" else 0) for i, k in enumerate(("close", "volume", "open"))}
    nodes = {f"f{i}": parse(t) for i, t in enumerate(FORMULAS)}
    got = np.full((len(nodes), 14, 3), np.nan)
    for r in compile_signals(panels.from_json(spark, document(**x)), nodes).collect():
        for i in range(len(nodes)):
            got[i, r["t"], r["ai"]] = np.nan if r[f"f{i}"] is None else r[f"f{i}"]
    for i, (text, node) in enumerate(zip(FORMULAS, nodes.values())):
        want = values(node, x, ["one", "two", "one"])
        assert np.allclose(got[i], want, rtol=1e-9, atol=1e-9, equal_nan=True), text


def test_the_past_alone_decides(spark):
    base = noise(3)
    later = base.copy()
    later[9:] = 99.0
    text = "rank(ts_mean(ts_delta(close, 2), 2))"
    one, two = ([r["x"] for r in compile_signals(panels.from_json(spark, document(close=c)), {"x": parse(text)}).filter("t < 9").orderBy("t", "ai").collect()] for c in (base, later))
    assert one == two


def test_shared_subtrees_and_axis_changes(spark):
    p = panels.from_json(spark, document(close=noise(1), volume=noise(2)))
    fs = {"a": parse("ts_mean(rank(ts_delta(close, 2)), 2)"), "b": parse("rank(ts_delta(close, 2))"), "c": parse("rank(ts_mean(rank(ts_delta(close, 2)), 2))")}
    both = {r["t"]: r for r in compile_signals(p, fs).filter("ai = 0").collect()}
    for k in fs:
        alone = {r["t"]: r["x"] for r in compile_signals(p, {"x": fs[k]}).filter("ai = 0").collect()}
        assert alone == {t: r[k] for t, r in both.items()}
    plan = compile_signals(p, {"x": fs["a"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    with pytest.raises(DatasetError):
        compile_signals(p, {"x": parse("rank(open)")})
    with pytest.raises(DatasetError):
        compile_signals(p, {"x": parse('group_rank(close, group("country"))')})


def test_decay(spark):
    x = noise(5)
    got = {(r["t"], r["ai"]): r["x"] for r in compile_signals(panels.from_json(spark, document(close=x)), {"x": parse("close")}, 3).collect()}
    for t in range(14):
        for a in range(3):
            want = None if t < 2 else (3 * x[t, a] + 2 * x[t - 1, a] + x[t - 2, a]) / 6
            assert got[t, a] == (None if want is None else pytest.approx(want))


def truncate(weights, cap):
    """Capping and sharing out until nothing is above the cap."""
    w = dict(weights)
    if len(w) * cap < 1 - 1e-12:
        return dict.fromkeys(w)
    fixed = set()
    while True:
        over = {k for k, v in w.items() if k not in fixed and abs(v) > cap + 1e-12}
        if not over:
            return w
        fixed |= over
        left = sum(abs(v) for k, v in w.items() if k not in fixed)
        for k in w:
            w[k] = math.copysign(cap, w[k]) if k in fixed else w[k] * (1 - cap * len(fixed)) / left if left else w[k]


def test_positions_and_cap_against_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for t in range(30):
        for ai in range(12):
            rows.append((t, ai, None if rng.random() < 0.1 or t == 4 else 1.0 if t == 5 else rng.choice([rng.gauss(0, 1), rng.gauss(0, 20), 0.5])))
    df = spark.createDataFrame(rows, "t int, ai int, x double")
    for cap in (0.0, 0.12, 0.3, 0.05):
        got = {(r["t"], r["ai"]): r["position"] for r in evaluation.with_positions(df, ["t"], "x", cap).collect()}
        for t in range(30):
            x = {ai: v for u, ai, v in rows if u == t and v is not None}
            mean = sum(x.values()) / len(x) if x else 0
            gross = sum(abs(v - mean) for v in x.values())
            want = {k: (v - mean) / gross for k, v in x.items()} if gross else dict.fromkeys(x)
            if cap and gross:
                want = truncate(want, cap)
            for ai in range(12):
                a, b = got[t, ai], want.get(ai)
                assert (a is None and b is None) or math.isclose(a, b, abs_tol=1e-9), (t, ai, cap)


def test_evidence_against_plain_loops(spark):
    rng = random.Random(11)
    T, A, h = 40, 5, 2
    cell = lambda p: None if rng.random() < p else rng.gauss(0, 1)
    close, real = [cell(0.1) for _ in range(T * A)], [cell(0.1) for _ in range(T * A)]
    for a in range(A):
        close[7 * A + a] = None
        close[9 * A + a] = 1.0
    d = {"schema": 1, "dataset_id": "d", "source_label": "s", "timestamps": list(range(100, 100 + T)), "assets": list("abcde"), "fields": {"close": {"values": close}}, "realized_returns": {"values": real}, "groups": {}}
    config = evaluation.EvaluationConfig(train_end=15, validation_end=26, evaluation_start=3, horizon=h, cost_bps=10, annualization_rows=252, proxy=True)
    e = evaluation.evidence(panels.from_json(spark, json.dumps(d)), {"x": parse("close")}, config)
    got = {r["split"]: r for r in e.metrics.collect()}
    for name, start, end in config.splits(T):
        prev, gross, turn, xs, os = [0.0] * A, [], [], [], []
        for t in range(start, end - h):
            x = close[t * A : t * A + A]
            known = [v for v in x if v is not None]
            mean = sum(known) / len(known) if known else 0
            total = sum(abs(v - mean) for v in known)
            pos = [None if v is None or not total else (v - mean) / total for v in x]
            out = []
            for a in range(A):
                r = [real[(t + k) * A + a] for k in range(1, h + 1)]
                out.append(None if None in r else sum(r))
                if x[a] is not None and out[a] is not None:
                    xs.append(x[a])
                    os.append(out[a])
            if any(p is not None and o is not None for p, o in zip(pos, out)):
                gross.append(sum(p * o for p, o in zip(pos, out) if p is not None and o is not None))
                now = [p or 0.0 for p in pos]
                turn.append(sum(abs(p - q) for p, q in zip(now, prev)))
                prev = now
        net = [g - t * 0.001 for g, t in zip(gross, turn)]
        r = got[name]
        close_to = lambda a, b: math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
        assert r["observations"] == len(xs) and close_to(r["pearson"], float(np.corrcoef(xs, os)[0, 1]))
        assert close_to(r["mean_gross"], np.mean(gross)) and close_to(r["mean_net"], np.mean(net)) and close_to(r["mean_turnover"], np.mean(turn))
        assert close_to(r["net_sharpe"], np.mean(net) / np.std(net) * math.sqrt(252))
        run = np.cumsum(net)
        assert close_to(r["net_drawdown"], float(np.max(np.maximum(np.maximum.accumulate(run), 0) - run)))
    assert e.daily.count() > 30 and e.daily.filter("target_timestamp - signal_timestamp <> 2").count() == 0


def test_batch_keeps_order_and_goes_on_after_failures(spark):
    p = panels.from_json(spark, document(close=noise(1, 16, 2), volume=noise(2, 16, 2)))
    config = evaluation.EvaluationConfig(train_end=6, validation_end=10)
    out = evaluation.evaluate_batch(["rank(close)", "rank(", "rank(open)", 'group_rank(close, group("country"))', "ts_mean(volume, 2)"], p, config)
    assert [r["status"] for r in out] == ["succeeded", "failed", "failed", "failed", "succeeded"] and set(out[0]["splits"]) == {"train", "validation", "holdout", "overall"}
    record = evaluation.evaluate("rank(close)", p, evaluation.EvaluationConfig(train_end=6, validation_end=10, include_daily=True))
    assert record["overall"]["observations"] > 0 and len(record["daily"]) == 15
    for bad in ({"train_end": 10, "validation_end": 6}, {"train_end": 6, "validation_end": 7}, {"train_end": 6, "validation_end": 10, "truncation": 2}, {"train_end": 6, "validation_end": 10, "proxy": True}, {"train_end": 6, "validation_end": 10, "cost_bps": -1}):
        with pytest.raises(evaluation.ConfigError):
            evaluation.EvaluationConfig(**bad).checked(16)


def test_panel_checks_and_json(spark):
    x = noise(4, 8, 2)
    for change in ({"schema": 2}, {"timestamps": [4, 4, *range(5, 11)]}, {"assets": ["a", "a"]}, {"groups": {"sector": ["one"]}}, {"groups": {"sector": ["one", ""]}}, {"fields": {"close": {"values": [1.0]}}}, {"dataset_id": " "}):
        with pytest.raises(DatasetError):
            panels.from_json(spark, json.dumps({**json.loads(document(close=x)), **change}))
    p = panels.from_json(spark, document(close=x))
    assert json.loads(panels.to_json(p))["fields"]["close"]["values"] == x.ravel().tolist()
    sparse = spark.createDataFrame([(3, "b", 1.0), (1, "a", 2.0), (2, "b", 4.0), (None, "a", 1.0)], "ts long, asset string, close double")
    d = densified(sparse, ["close"])
    assert (d.rows, d.assets, d.df.count()) == (3, 2, 6) and d.checked().rows == 3


def test_universe(spark, tmp_path):
    day = dt.date
    dates, cap = [day(2020, 1, 2), day(2020, 1, 3), day(2020, 1, 6), day(2020, 1, 7)], {"A": 300.0, "B": 200.0, "C": 100.0}
    daily = [(t, d, 400.0 if (t, d.day) == ("C", 3) else cap[t]) for d in dates for t in cap] + [("A", dates[0], 1.0), ("B", dates[0], float("nan")), (None, dates[0], 5.0)]
    stocks = [(t, d, 10.0 + i + j, 20.0 + 2 * i + 2 * j, 18.0, 24.0, 16.0, 100.0) for i, d in enumerate(dates) for j, t in enumerate(cap)] + [("A", dates[1], 99.0, 99.0, 1.0, 1.0, 1.0, -5.0)]
    for table, rows, schema in (("daily", daily, "ticker string, date date, marketcap double"), ("stocks", stocks, "ticker string, date date, closeadj double, close double, open double, high double, low double, volume double")):
        spark.createDataFrame(rows, schema).coalesce(1).write.option("compression", "zstd").parquet(f"{tmp_path}/{table}/partition_year=2020")
    config = universe.UniverseConfig(dates[0], dates[-1], 2, "u")
    p = universe.prepare(spark, str(tmp_path), config).checked()
    rows = {(r["ts"], r["asset"]): r for r in p.df.collect()}
    assert p.rows == 4 and p.assets == 3
    b = rows[20200103, "B"]
    assert b["close"] is None and b["returns"] is None and b["realized_returns"] == pytest.approx(12 / 11 - 1)
    assert rows[20200103, "C"]["close"] == 13.0 and rows[20200102, "C"]["close"] is None and rows[20200102, "A"]["open"] == pytest.approx(9.0) and rows[20200102, "A"]["realized_returns"] is None
    assert universe.first_row_on_or_after(p, day(2020, 1, 4)) == 2
    with pytest.raises(DatasetError):
        universe.prepare(spark, str(tmp_path), universe.UniverseConfig(day(2019, 12, 30), dates[-1], 2))
    with pytest.raises(DatasetError):
        universe.UniverseConfig(dates[-1], dates[0], 2).checked()


ROWS = "row_id long, dataset_id string, asset string, ts long, bar_no int, fld_volume double, realized_returns double, ingested_at int, day int, bucket string"
SETS = "dataset_id string, ts_unit string, last_day int"


def test_rolling_totals_of_a_calendar(spark):
    rng = random.Random(2)
    units = {"p": "yyyymmdd", "q": "epoch_s", "r": "epoch_ms"}
    start = dt.date(2021, 1, 20)
    stamp = {"p": lambda d: d.year * 10000 + d.month * 100 + d.day, "q": lambda d: int((d - dt.date(1970, 1, 1)).days) * 86400 + 7, "r": lambda d: int((d - dt.date(1970, 1, 1)).days) * 86400000 + 7}
    rows, truth, i = [], {}, 0
    for ds in units:
        for asset in ("x", "y"):
            for k in sorted(rng.sample(range(90), 30)):
                d = start + dt.timedelta(days=k)
                v = rng.choice([None, float("nan"), -4.0, float("inf"), 5.0, 7.0, 100.0])
                for version, value in ((0, 1e6), (1, v)):
                    i += 1
                    rows.append((i, ds, asset, stamp[ds](d), 0, value, rng.random(), version, 1, "clash"))
                rows.append(rows[-1])
                truth[ds, asset, d] = v if v is not None and v == v and 0 < v < 1e9 else 0.0
    rows += [(0, None, "x", 1, 0, 1.0, 1.0, 1, 1, ""), (0, "p", None, 1, 0, 1.0, 1.0, 1, 1, ""), (0, "zz", "x", 1, 0, 1.0, 1.0, 1, 1, ""), (0, "p", "x", 20219999, 0, 1.0, 1.0, 1, 1, "")]
    last = start + dt.timedelta(days=95)
    sets = spark.createDataFrame([(d, u, last.year * 10000 + last.month * 100 + last.day) for d, u in units.items()], SETS)
    df = spark.createDataFrame(rows, ROWS)
    got = {(r["dataset_id"], r["asset"], r["day"]): r for r in calendar.panel_totals(df, sets).collect()}
    for ds in units:
        for asset in ("x", "y"):
            own = {d: v for (a, b, d), v in truth.items() if (a, b) == (ds, asset)}
            first = min(own)
            days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
            assert sum(k[:2] == (ds, asset) for k in got) == len(days)
            for n, d in enumerate(days, 1):
                for p in (7, 30):
                    total = sum(v for x, v in own.items() if d - dt.timedelta(days=p) < x <= d)
                    r = got[ds, asset, d]
                    assert r[f"fld_volume_total_{p}"] == total and r[f"fld_volume_mean_{p}"] == pytest.approx(total / min(p, n)) and r["day_index"] == n
    found = calendar.volume_bursts(df, sets).count()
    assert found == sum(r["day_index"] >= 30 and r["fld_volume_total_7"] > 0.7 * r["fld_volume_total_30"] for r in got.values())
    assert calendar.panel_totals(df.limit(0), sets).count() == 0


def test_latest_and_numbering(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (1, None, "c"), (2, 1, "d"), (None, 9, "e")], "k int, v int, x string")
    assert sorted((r["k"], r["x"]) for r in latest(df, ["k"], [F.col("v").desc_nulls_last()]).collect()) == [(1, "b"), (2, "d")]
    n = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6), "v", "i")
    assert n.filter("v <> i").count() == 0 and n.count() == 1000


def test_a_share_of_exactly_seven_tenths_is_no_burst(spark):
    """v7 = 0.7 x v30 on day 30 for every total, also those whose product with the double 0.7 is rounded down."""
    rows, last = [], dt.date(2024, 1, 30)
    for k in range(1, 60):
        for day, volume in ((1, 3.0 * k), (30, 7.0 * k + (k % 5 == 0))):
            rows.append((k * 100 + day, "d", f"a{k:02d}", 20240100 + day, 0, volume, None, dt.datetime(2024, 2, 1)))
    df = spark.createDataFrame(rows, "row_id long, dataset_id string, asset string, ts long, bar_no int, fld_volume double, realized_returns double, ingested_at timestamp")
    sets = spark.createDataFrame([("d", "yyyymmdd", int(last.strftime("%Y%m%d")))], "dataset_id string, ts_unit string, last_day int")
    got = sorted(r["asset"] for r in calendar.volume_bursts(df, sets).collect())
    assert got == [f"a{k:02d}" for k in range(5, 60, 5)] and any(7.0 * k > 0.7 * (10.0 * k) for k in range(1, 60) if k % 5)


@pytest.mark.parametrize("chunk", [24, 1 << 16])
def test_long_windows_over_chunks_against_plain_loops(spark, chunk):
    from panelforge.functions import kernels

    x = {"close": noise(21, rows=90, gaps=0.02)}
    x["close"][60:] = np.round(x["close"][60:])  # ties
    df = panels.from_json(spark, document(**x)).df
    asked = {f"{n}_{w}": (n, "close", w) for n in ("ts_median", "ts_mad", "ts_rank", "ts_wma", "ts_ema") for w in (5, 17, 20)}
    got = {c: np.full((90, 3), np.nan) for c in asked}
    rows = kernels.with_kernels(df, asked, chunk).collect()
    assert len(rows) == 270
    for r in rows:
        for c in asked:
            got[c][r["t"], r["ai"]] = np.nan if r[c] is None else r[c]
    for c, (n, _, w) in asked.items():
        assert np.allclose(got[c], values(parse(f"{n}(close, {w})"), x), rtol=1e-9, atol=1e-9, equal_nan=True), c
    with pytest.raises(ValueError):
        kernels.with_kernels(df, {"a": ("ts_median", "close", 40)}, 24)


def test_compiled_long_windows_and_decay(spark):
    x = {"close": noise(22, rows=60)}
    p = panels.from_json(spark, document(**x))
    nodes = {"a": parse("rank(ts_median(zscore(close), 20))"), "b": parse("ts_wma(ts_mean(close, 3), 18)"), "c": parse("ts_median(close, 4)")}
    rows = compile_signals(p, nodes).collect()
    for k, n in nodes.items():
        got = np.full((60, 3), np.nan)
        for r in rows:
            got[r["t"], r["ai"]] = np.nan if r[k] is None else r[k]
        assert np.allclose(got, values(n, x, ["one", "two", "one"]), rtol=1e-9, atol=1e-9, equal_nan=True), k
    for n in (5, 20):
        decayed = {(r["t"], r["ai"]): r["x"] for r in compile_signals(p, {"x": parse("close")}, n).collect()}
        assert len(decayed) == 180
        for t in range(60):
            want = None if t < n - 1 else float(np.average(x["close"][t - n + 1 : t + 1, 1], weights=np.arange(1, n + 1)))
            assert decayed[t, 1] == (None if want is None else pytest.approx(want))


def test_a_kept_panel_is_made_anew_when_its_file_changes(spark, tmp_path):
    def write(n):
        rows = [(i, dt.datetime(2024, 1, 1 + i // 4, i % 4), "ab"[i % 2], float(i)) for i in range(n)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))

    write(24)
    first = panels.events_daily(spark, str(tmp_path))
    assert panels.events_daily(spark, str(tmp_path)) is first and (first.rows, first.assets, first.df.count()) == (6, 2, 12)
    plan = compile_signals(first, {"x": parse("ts_mean(ts_delta(close, 2), 3)")})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    write(40)
    again = panels.events_daily(spark, str(tmp_path))
    assert (again.rows, again.df.count()) == (10, 20)
