"""SQL (DuckDB) that the queries of ``queries_core`` are held against."""

from __future__ import annotations

_DAY = "CAST(year({0}) * 10000 + month({0}) * 100 + day({0}) AS BIGINT)"


def _panel(bars: str, group: bool) -> str:
    """CTEs ending in ``panel``: t, ts, ai, asset, fields, returns, realized_returns[, sector]."""
    labels, sector, join = "", "", ""
    if group:
        labels, sector, join = ", labels AS (SELECT asset, min(sector) AS sector FROM bars GROUP BY 1)", ", labels.sector AS sector", " LEFT JOIN labels ON labels.asset = names.asset"
    return f"""{bars}{labels}, times AS (SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT ts FROM bars)),
  names AS (SELECT asset, CAST(row_number() OVER (ORDER BY asset) - 1 AS INTEGER) AS ai FROM (SELECT DISTINCT asset FROM bars)),
  grid AS (SELECT t, times.ts AS ts, ai, names.asset AS asset{sector}, open, high, low, close, volume FROM times CROSS JOIN names LEFT JOIN bars ON bars.ts = times.ts AND bars.asset = names.asset{join}),
  panel AS (SELECT *, close / lag(close) OVER (PARTITION BY ai ORDER BY t) - 1 AS returns, close / lag(close) OVER (PARTITION BY ai ORDER BY t) - 1 AS realized_returns FROM grid)"""


_LINE = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _bars(source: str, keys: str, price: str, order: str, volume: str) -> str:
    return f"bars AS (SELECT {keys}, first({price} ORDER BY {order}) AS open, max({price}) AS high, min({price}) AS low, last({price} ORDER BY {order}) AS close, CAST({volume} AS DOUBLE) AS volume FROM {source} GROUP BY ALL)"


_EVENTS = "WITH " + _panel("e AS (SELECT " + _DAY.format("ts") + " AS d, event_type AS asset, value, ts AS moment, event_id FROM events), " + _bars("e", "d AS ts, asset", "value", "moment, event_id", "count(*)"), False)

_BRANDS = "WITH " + _panel(
    "x AS (SELECT *, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey), "
    + _bars("x", _DAY.format("week") + " AS ts, p_brand AS asset, 's' || (CAST(substr(p_brand, 7) AS INTEGER) % 5) AS sector", "price", _LINE, "sum(l_quantity)"),
    True,
)

_SUPPLY = "WITH " + _panel(
    "x AS (SELECT *, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_extendedprice / l_quantity AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
    + _bars("x", _DAY.format("month") + " AS ts, n_name AS asset, r_name AS sector", "price", _LINE, "sum(l_quantity)"),
    True,
)

_X = "p AS (SELECT *, close / 997 AS x, volume / 100 AS v, high / 997 AS h, low / 997 AS l FROM panel)"


def _f(w: int) -> str:
    return f"(PARTITION BY ai ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _full(expression: str, w: int, x: str = "x") -> str:
    return f"CASE WHEN count({x}) OVER {_f(w)} = {w} THEN {expression} END"


def _rank(x: str, keys: str = "t") -> str:
    n = f"count({x}) OVER (PARTITION BY {keys})"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY {keys} ORDER BY {x} ASC NULLS LAST, ai) - 1) / CAST({n} - 1 AS DOUBLE) END"


def _list(w: int) -> str:
    return f"list(x) FILTER (WHERE x IS NOT NULL) OVER {_f(w)}"


def _weighted(weights: list[float]) -> str:
    w = len(weights)
    terms = " + ".join(f"{float(c)!r} * lag(x, {w - 1 - i}) OVER (PARTITION BY ai ORDER BY t)" for i, c in enumerate(weights))
    return _full(f"({terms}) / {float(sum(weights))!r}", w)


_W5 = _f(5)
_MU = f"avg(x) OVER {_W5}"


# expressions over the panel p
_SIMPLE = {
    "negate": "-x", "abs": "abs(x - lag(x, 2) OVER (PARTITION BY ai ORDER BY t))", "sign": "CAST(sign(close - lag(close, 2) OVER (PARTITION BY ai ORDER BY t)) AS DOUBLE)", "subtract": "(high - low) / 997", "divide": "x",
    "add": "x + h + l", "multiply": "x * v * 0.5", "clip": "CASE WHEN x IS NULL THEN NULL ELSE least(greatest(x, 1.5), 2.5) END",
    "greater": "CASE WHEN close - lag(close, 3) OVER (PARTITION BY ai ORDER BY t) > 10 THEN v WHEN close - lag(close, 3) OVER (PARTITION BY ai ORDER BY t) <= 10 THEN x END",
    "if_else": "CASE WHEN x > 2 THEN h WHEN x <= 2 THEN l END", "if_else_true": "x", "if_else_false": "v", "rank": _rank("close"), "group_rank": _rank("close", "t, sector"),
    "zscore": "CASE WHEN x IS NULL THEN NULL WHEN stddev_pop(x) OVER (PARTITION BY t) = 0 THEN 0 ELSE (x - avg(x) OVER (PARTITION BY t)) / stddev_pop(x) OVER (PARTITION BY t) END",
    "winsorize": "CASE WHEN x IS NULL THEN NULL ELSE least(greatest(x, avg(x) OVER (PARTITION BY t) - 1.2 * stddev_pop(x) OVER (PARTITION BY t)), avg(x) OVER (PARTITION BY t) + 1.2 * stddev_pop(x) OVER (PARTITION BY t)) END",
    "ts_delay": "lag(x, 3) OVER (PARTITION BY ai ORDER BY t)", "ts_delta": "x - lag(x, 2) OVER (PARTITION BY ai ORDER BY t)", "ts_sum": _full(f"sum(x) OVER {_W5}", 5), "ts_mean": _full(_MU, 5),
    "ts_std_dev": _full(f"stddev_pop(x) OVER {_W5}", 5), "ts_zscore": _full(f"CASE WHEN stddev_pop(x) OVER {_W5} = 0 THEN 0 ELSE (x - {_MU}) / stddev_pop(x) OVER {_W5} END", 5), "ts_var": _full(f"var_samp(x) OVER {_W5}", 5),
    "ts_min": _full(f"min(x) OVER {_W5}", 5), "ts_max": _full(f"max(x) OVER {_W5}", 5), "ts_median": _full(f"quantile_disc(x, 0.5) OVER {_W5}", 5), "ts_wma": _weighted([0, 1, 2, 3, 4]), "ts_ema": _weighted([(2 / 3) ** (5 - i) for i in range(5)]),
    "signal_decay": _weighted([1, 2, 3, 4, 5]),
}

# operators that need the window's values: l is their list, mu their mean
_LISTED = {
    "ts_skew": (5, "CASE WHEN m2 = 0 THEN NULL ELSE m3 / power(m2, 1.5) END"), "ts_kurt": (5, "CASE WHEN m2 = 0 THEN NULL ELSE m4 / power(m2 * 5 / 4.0, 2) - 3 END"), "ts_mad": (5, "list_sum(list_transform(l, lambda z: abs(z - mu))) / 5.0"),
    "ts_rank": (6, "(len(list_filter(l, lambda z: z <= x)) - 1) / 5.0"),
}


def _operator(name: str) -> str:
    if name in _SIMPLE:
        return f"{_BRANDS}, {_X} SELECT ts, asset, round({_SIMPLE[name]}, 6) + 0.0 AS x FROM p"
    if name in _LISTED:
        w, e = _LISTED[name]
        return f"""{_BRANDS}, {_X}, w AS (SELECT ts, asset, x, count(x) OVER {_f(w)} AS n, {_list(w)} AS l, avg(x) OVER {_f(w)} AS mu FROM p),
  m AS (SELECT *, list_sum(list_transform(l, lambda z: power(z - mu, 2))) / n AS m2, list_sum(list_transform(l, lambda z: power(z - mu, 3))) / n AS m3, list_sum(list_transform(l, lambda z: power(z - mu, 4))) / n AS m4 FROM w WHERE n > 0)
  SELECT w.ts, w.asset, round(CASE WHEN w.n = {w} THEN q.x END, 6) + 0.0 AS x FROM w LEFT JOIN (SELECT ts, asset, {e} AS x FROM m) q USING (ts, asset)"""
    pair = "CASE WHEN x IS NOT NULL AND v IS NOT NULL THEN {} END"
    cov = f"covar_samp(a, b) OVER {_f(10)}"
    corr = f"CASE WHEN var_pop(a) OVER {_f(10)} * 10 < 1e-6 OR var_pop(b) OVER {_f(10)} * 10 < 1e-6 THEN covar_pop(a, b) OVER {_f(10)} * 10 ELSE covar_pop(a, b) OVER {_f(10)} / (stddev_pop(a) OVER {_f(10)} * stddev_pop(b) OVER {_f(10)}) END"
    e = {"ts_cov": cov, "ts_corr": corr}[name]
    return f"{_BRANDS}, {_X}, q AS (SELECT *, {pair.format('x')} AS a, {pair.format('v')} AS b FROM p) SELECT ts, asset, round({_full(e, 10, 'a')}, 6) + 0.0 AS x FROM q"


_SIGNAL = f"""{_BRANDS}, {_X}, d AS (SELECT *, x - lag(x, 2) OVER (PARTITION BY ai ORDER BY t) AS dx FROM p), sig AS (SELECT t, ts, ai, asset, realized_returns, {_rank('dx')} AS s,
  CASE WHEN count(realized_returns) OVER (PARTITION BY ai ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) = 2 THEN sum(realized_returns) OVER (PARTITION BY ai ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) END AS o FROM d),
  cen AS (SELECT *, s - avg(s) OVER (PARTITION BY t) AS c FROM sig), pos AS (SELECT *, CASE WHEN sum(abs(c)) OVER (PARTITION BY t) = 0 THEN NULL ELSE c / sum(abs(c)) OVER (PARTITION BY t) END AS q FROM cen)"""

# the cap by repeated capping and sharing out, up to as often as there are assets
_TRUNCATED = f"""{_SIGNAL.replace('WITH ', 'WITH RECURSIVE ', 1)}, step AS (SELECT 0 AS i, ts, asset, q AS w, false AS fixed FROM pos
  UNION ALL SELECT i + 1, ts, asset, CASE WHEN fixed OR abs(w) > 0.06 THEN CASE WHEN w < 0 THEN -0.06 ELSE 0.06 END
    ELSE w * (1 - 0.06 * count(*) FILTER (WHERE fixed OR abs(w) > 0.06) OVER (PARTITION BY ts)) / sum(CASE WHEN fixed OR abs(w) > 0.06 THEN 0 ELSE abs(w) END) OVER (PARTITION BY ts) END,
    fixed OR abs(w) > 0.06 FROM step WHERE i < 25)
  SELECT s.ts, s.asset, round(CASE WHEN count(s.w) OVER (PARTITION BY s.ts) * 0.06 < 1 THEN NULL ELSE s.w END, 6) + 0.0 AS position FROM step s WHERE i = 25"""

_EVAL = f"""{_SIGNAL}, periods(split, a, b) AS (VALUES ('train', 10, 150), ('validation', 150, 250), ('holdout', 250, (SELECT max(t) + 1 FROM panel)), ('overall', 10, (SELECT max(t) + 1 FROM panel))),
  wi AS (SELECT split, pos.* FROM pos JOIN periods ON t >= a AND t < b - 2),
  act AS (SELECT *, count(q * o) OVER (PARTITION BY split, t) AS n FROM wi), mov AS (SELECT *, abs(coalesce(q, 0) - coalesce(lag(coalesce(q, 0)) OVER (PARTITION BY split, ai ORDER BY t), 0)) AS m FROM act WHERE n > 0),
  day AS (SELECT split, t, ts, sum(q * o) AS gross, sum(m) AS turnover, sum(q * o) - sum(m) * 0.0005 AS net FROM mov GROUP BY 1, 2, 3),
  run AS (SELECT *, sum(gross) OVER w AS cg, sum(net) OVER w AS cn FROM day WINDOW w AS (PARTITION BY split ORDER BY t ROWS UNBOUNDED PRECEDING)),
  dd AS (SELECT *, greatest(max(cg) OVER w, 0) - cg AS dg, greatest(max(cn) OVER w, 0) - cn AS dn FROM run WINDOW w AS (PARTITION BY split ORDER BY t ROWS UNBOUNDED PRECEDING)),
  per AS (SELECT split, avg(gross) AS mean_gross, avg(net) AS mean_net, avg(turnover) AS mean_turnover, avg(gross) * 52 AS annual_gross, avg(net) * 52 AS annual_net, avg(gross) / stddev_pop(gross) * sqrt(52) AS gross_sharpe,
    avg(net) / stddev_pop(net) * sqrt(52) AS net_sharpe, max(dg) AS gross_drawdown, max(dn) AS net_drawdown FROM dd GROUP BY 1),
  pr AS (SELECT split, count(*) AS observations, covar_pop(s, o) / (stddev_pop(s) * stddev_pop(o)) AS pearson FROM wi WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY 1)"""

_METRICS = ["pearson", "mean_gross", "mean_net", "mean_turnover", "annual_gross", "annual_net", "gross_sharpe", "net_sharpe", "gross_drawdown", "net_drawdown"]


def _six(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


_MARKET = """x AS (SELECT *, p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
  caps AS (SELECT date, ticker, max(l_extendedprice) AS marketcap FROM x WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND l_extendedprice > 0 GROUP BY 1, 2),
  members AS (SELECT date, ticker, marketcap FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY marketcap DESC, ticker) AS rn FROM caps) WHERE rn <= 5)"""

_PREP = f"""WITH {_MARKET}, rows AS (SELECT * FROM (SELECT ticker, date, price * (1 - l_discount) AS closeadj, price AS close, price * 1.01 AS open, l_quantity AS volume,
    row_number() OVER (PARTITION BY ticker, date ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM x WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND ticker IN (SELECT ticker FROM members)) WHERE rn = 1),
  ret AS (SELECT *, closeadj / lag(closeadj) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM rows),
  grid AS (SELECT d.date AS date, a.ticker AS ticker FROM (SELECT DISTINCT date FROM members) d CROSS JOIN (SELECT DISTINCT ticker FROM members) a)
  SELECT {_DAY.format('g.date')} AS ts, g.ticker AS asset, CASE WHEN m.ticker IS NOT NULL THEN round(ret.closeadj / 997, 6) + 0.0 END AS close, CASE WHEN m.ticker IS NOT NULL THEN round(ret.open * (ret.closeadj / ret.close) / 997, 6) + 0.0 END AS open,
    CASE WHEN m.ticker IS NOT NULL THEN round(ret.volume, 6) + 0.0 END AS volume, CASE WHEN m.ticker IS NOT NULL THEN round(r, 6) + 0.0 END AS returns, round(r, 6) + 0.0 AS realized_returns
  FROM grid g LEFT JOIN members m ON m.date = g.date AND m.ticker = g.ticker LEFT JOIN ret ON ret.date = g.date AND ret.ticker = g.ticker"""

_FB = """WITH ds AS (SELECT DISTINCT ON (dataset_id) * FROM feedback_datasets WHERE dataset_id IS NOT NULL), scale AS (SELECT dataset_id, e.key AS k, e.value AS s FROM (SELECT dataset_id, unnest(map_entries(feature_scales)) AS e FROM ds)),
  keys AS (SELECT dataset_id, count(*) AS nk FROM scale GROUP BY 1),
  src AS (SELECT DISTINCT dataset_id, record_id, semantic_fingerprint, features, outcome, confidence FROM feedback_records WHERE outcome BETWEEN -1 AND 1 AND confidence > 0 AND confidence <= 1),
  kv AS (SELECT dataset_id, record_id, semantic_fingerprint, outcome, confidence, e.key AS k, e.value AS v FROM (SELECT *, unnest(map_entries(features)) AS e FROM src)),
  good AS (SELECT kv.dataset_id, record_id FROM kv LEFT JOIN scale USING (dataset_id, k) LEFT JOIN keys ON keys.dataset_id = kv.dataset_id GROUP BY 1, 2 HAVING count(*) = max(nk) AND count(s) = count(*) AND count(v) = count(*) AND bool_and(isfinite(v))),
  num AS (SELECT kv.*, s FROM kv JOIN good USING (dataset_id, record_id) JOIN scale USING (dataset_id, k))"""

_EST = """near AS (SELECT *, power(greatest(1 - d, 1e-9), 2) * c AS w FROM (SELECT dist.*, neighbors AS nn, minimum_neighbors AS mn, row_number() OVER (PARTITION BY dataset_id, a ORDER BY d, b) AS place FROM dist JOIN ds USING (dataset_id) WHERE d <= maximum_distance) WHERE place <= nn),
  est AS (SELECT dataset_id, a AS query, count(*) AS neighbors, avg(d) AS mean_distance, sum(w * o) / sum(w) AS weighted_outcome, sqrt(greatest(sum(w * o * o) / sum(w) - power(sum(w * o) / sum(w), 2), 0)) AS dispersion FROM near GROUP BY 1, 2 HAVING count(*) >= max(mn)),
  cau AS (SELECT *, least(1, greatest(-1, weighted_outcome - dispersion / sqrt(neighbors))) AS conservative_outcome FROM est)"""

_LOO = f"""{_FB},
  dist AS (SELECT a.dataset_id, a.record_id AS a, b.record_id AS b, any_value(b.outcome) AS o, any_value(b.confidence) AS c, avg(least(abs(a.v - b.v) / a.s, 1)) AS d FROM num a JOIN num b ON a.dataset_id = b.dataset_id AND a.k = b.k AND a.record_id <> b.record_id GROUP BY 1, 2, 3),
  {_EST}, act AS (SELECT DISTINCT dataset_id, record_id, outcome FROM num), pred AS (SELECT act.dataset_id, record_id, outcome AS a, weighted_outcome AS p FROM act LEFT JOIN est ON query = record_id AND est.dataset_id = act.dataset_id)"""

_TIDY = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_CURRENT = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY written_at DESC NULLS LAST, structural_score DESC NULLS LAST, fingerprint DESC NULLS LAST) AS rn FROM candidates WHERE candidate_id IS NOT NULL) WHERE rn = 1)"""


def _features() -> str:
    """CTEs ending in ``feat``: i, feature, value for every feature of ``c``: i, root_family, nodes, depth, d (descriptor), whose lists are distinct and without nulls."""
    from panelforge.search import feedback as f

    byte = lambda t: f"CAST('0x' || substr(sha256({t}), 1, 2) AS INTEGER)"
    ops = lambda names: " + ".join(f"coalesce(d.operator_histogram['{n}'], 0)" for n in names)
    total = lambda m: f"coalesce(list_sum(map_values(d.{m})), 0)"
    plain = {
        "conditional": "CAST(coalesce(d.conditional, false) AS INTEGER)", "nonlinear": "CAST(coalesce(d.nonlinear, false) AS INTEGER)", "depth": "depth", "nodes": "nodes", "field_count": "len(fields)", "field_family_count": "len(field_families)", "group_count": "len(groups)",
        "lineage_parent_count": "len(lineage_parents)", "operator_count": total("operator_histogram"), "window_total_count": total("window_buckets"), **{f"window_{w}_count": f"coalesce(d.window_buckets['{w}'], 0)" for w in ("long", "medium", "short")},
        **{f"operator_{k}_count": ops(v) for k, v in f.FAMILIES.items()}, **{f"operator_{o}_count": ops([o]) for o in f.COUNTED},
    }
    rows = ", ".join(f"{{'f': '{k}', 'v': CAST({v} AS DOUBLE)}}" for k, v in plain.items())
    buckets = (("field_family_bucket", f.FAMILY_BUCKETS), (f"field_{f.FIELD_BUCKETS}_bucket", f.FIELD_BUCKETS), (f"interaction_{f.INTERACTION_BUCKETS}_bucket", f.INTERACTION_BUCKETS))
    named = " UNION ALL ".join(f"SELECT i, '{p}_' || CAST(b AS VARCHAR) || '_count' AS feature FROM c, range({n}) r(b)" for p, n in buckets)
    return f"""fl AS (SELECT i, unnest(fields) AS f FROM c), fa AS (SELECT i, unnest(field_families) AS f FROM c), sh AS (SELECT i, unnest(operator_shingles) AS s FROM c),
  op AS (SELECT i, e.key AS k, e.value AS n FROM (SELECT i, unnest(map_entries(d.operator_histogram)) AS e FROM c)), wi AS (SELECT i, e.key AS k, e.value AS n FROM (SELECT i, unnest(map_entries(d.window_buckets)) AS e FROM c)),
  tok AS (SELECT i, 'root_field:' || coalesce(root_family, '') || ':' || f AS t, 1 AS n FROM fl JOIN c USING (i) UNION ALL SELECT i, 'operator_field:' || k || ':' || f, n FROM fl JOIN op USING (i)
    UNION ALL SELECT op.i, 'operator_window:' || op.k || ':' || wi.k, op.n * wi.n FROM op JOIN wi ON op.i = wi.i UNION ALL SELECT i, 'operator_shingle:' || s, 1 FROM sh),
  hit AS (SELECT i, '{buckets[0][0]}_' || CAST({byte("f")} % {buckets[0][1]} AS VARCHAR) || '_count' AS feature, count(*) AS n FROM fa GROUP BY 1, 2 UNION ALL SELECT i, '{buckets[1][0]}_' || CAST({byte("f")} % {buckets[1][1]} AS VARCHAR) || '_count', count(*) FROM fl GROUP BY 1, 2
    UNION ALL SELECT i, '{buckets[2][0]}_' || CAST({byte("t")} % {buckets[2][1]} AS VARCHAR) || '_count', sum(n) FROM tok GROUP BY 1, 2),
  feat AS (SELECT i, x.f AS feature, x.v AS value FROM (SELECT i, unnest([{rows}]) AS x FROM c) UNION ALL SELECT a.i, a.feature, CAST(coalesce(n, 0) AS DOUBLE) FROM ({named}) a LEFT JOIN hit ON hit.i = a.i AND hit.feature = a.feature)"""


_LISTS = ("fields", "field_families", "groups", "lineage_parents", "operator_shingles")


_CUR = "SELECT candidate_id, any_value(structural_descriptor) AS d FROM candidates GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    from panelforge.queries_core import OPERATORS

    out = {f"op_{n}": _operator(n) for n in OPERATORS}
    out["op_signal_decay"] = _operator("signal_decay")
    delta = "close / 997 - lag(close / 997, 2) OVER (PARTITION BY ai ORDER BY t)"
    out["flagship"] = f"{_EVENTS}, p AS (SELECT *, close - lag(close, 2) OVER (PARTITION BY ai ORDER BY t) AS d FROM panel) SELECT ts, asset, round({_rank('d')}, 6) + 0.0 AS x FROM p"
    five = _f(5)
    out["op_nested_batch"] = f"""{_SUPPLY}, p1 AS (SELECT *, {delta} AS d FROM panel), p2 AS (SELECT *, {_rank('d')} AS r, {_rank('d', 't, sector')} AS c FROM p1),
  p3 AS (SELECT *, CASE WHEN count(r) OVER {five} = 5 THEN avg(r) OVER {five} END AS a FROM p2), p4 AS (SELECT *, round(a, 12) AS ar FROM p3)
  SELECT ts, asset, round(a, 6) + 0.0 AS a, round({_rank('a')}, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c FROM p4"""
    out["eval_future_return"] = f"{_SIGNAL} SELECT ts, asset, round(o, 6) + 0.0 AS outcome FROM sig"
    out["eval_positions"] = f"{_SIGNAL} SELECT ts, asset, round(q, 6) + 0.0 AS position FROM pos"
    out["eval_positions_truncated"] = _TRUNCATED
    out["eval_daily_pnl"] = f"""{_EVAL} SELECT day.ts AS signal_timestamp, e.ts AS target_timestamp, {_six(['gross', 'net', 'turnover'])} FROM day JOIN (SELECT DISTINCT t, ts FROM panel) e ON e.t = day.t + 2 WHERE split = 'overall'"""
    out["eval_split_metrics"] = f"{_EVAL} SELECT split, observations, {_six(_METRICS)} FROM per JOIN pr USING (split)"
    out["eval_proxy"] = f"""{_EVAL}, px AS (SELECT split, mean_gross * 104 AS proxy_returns, gross_drawdown * 2 AS proxy_drawdown, mean_gross / mean_turnover AS proxy_margin, gross_sharpe * sqrt(abs(mean_gross * 104) / greatest(mean_turnover, 0.125)) AS proxy_fitness FROM per)
  SELECT split, {_six(['proxy_returns', 'proxy_drawdown', 'proxy_margin', 'proxy_fitness'])} FROM px"""
    out["prep_universe_topn"] = f"WITH {_MARKET} SELECT CAST(date AS VARCHAR) AS date, ticker, round(marketcap, 6) + 0.0 AS marketcap FROM members"
    out["prep_realized_returns"] = _PREP
    estimate = f"round(mean_distance + 1e-9, 6) + 0.0 AS mean_distance, {_six(['weighted_outcome', 'dispersion', 'conservative_outcome'])}"
    out["feedback_knn"] = f"{_LOO} SELECT dataset_id, query, neighbors, {estimate} FROM cau"
    out["feedback_screen"] = f"{_LOO} SELECT act.dataset_id, record_id AS id, coalesce(conservative_outcome >= 0, false) AS eligible FROM act LEFT JOIN cau ON query = record_id AND cau.dataset_id = act.dataset_id"
    out["feedback_loo_audit"] = f"""{_LOO} SELECT dataset_id, count(*) AS records, count(p) AS predicted, round(count(p) / count(*), 6) + 0.0 AS coverage, round(avg(abs(p - a)), 6) + 0.0 AS mae, round(sqrt(avg(power(p - a, 2))), 6) + 0.0 AS rmse,
  round(count(*) FILTER (WHERE (p > 0 AND a > 0) OR (p < 0 AND a < 0)) / nullif(count(*) FILTER (WHERE p IS NOT NULL AND a <> 0), 0), 6) + 0.0 AS sign_accuracy,
  round((count(*) FILTER (WHERE p > 0 AND a > 0) / nullif(count(*) FILTER (WHERE p IS NOT NULL AND a > 0), 0) + count(*) FILTER (WHERE p <= 0 AND a < 0) / nullif(count(*) FILTER (WHERE p IS NOT NULL AND a < 0), 0)) / 2, 6) + 0.0 AS balanced_accuracy FROM pred GROUP BY 1"""
    own = lambda n: f"list_distinct(list_transform(list_filter(coalesce(structural_descriptor.{n}, []), lambda v: v IS NOT NULL), lambda v: {_TIDY.format('v')})) AS {n}"
    out["feedback_guided"] = f"""{_FB}, {_CURRENT}, c AS (SELECT candidate_id AS i, {_TIDY.format('root_family')} AS root_family, nodes, depth, structural_descriptor AS d, {", ".join(map(own, _LISTS))} FROM cur WHERE structural_descriptor IS NOT NULL),
  {_features()}, q AS (SELECT dataset_id, i, k, value AS v, s FROM feat JOIN scale ON k = feature), whole AS (SELECT dataset_id, i FROM q JOIN keys USING (dataset_id) GROUP BY 1, 2 HAVING count(v) = max(nk) AND bool_and(isfinite(v))),
  dist AS (SELECT q.dataset_id, q.i AS a, r.record_id AS b, any_value(r.outcome) AS o, any_value(r.confidence) AS c, avg(least(abs(q.v - r.v) / q.s, 1)) AS d FROM q JOIN whole USING (dataset_id, i) JOIN num r ON r.dataset_id = q.dataset_id AND r.k = q.k GROUP BY 1, 2, 3),
  {_EST}, measured AS (SELECT dataset_id, semantic_fingerprint AS f, arg_max(outcome, (confidence, record_id)) AS m FROM (SELECT DISTINCT dataset_id, record_id, semantic_fingerprint, outcome, confidence FROM num) WHERE semantic_fingerprint IS NOT NULL GROUP BY 1, 2),
  met AS (SELECT ds.dataset_id, candidate_id, cur.semantic_fingerprint AS f, CASE WHEN isnan(structural_score) THEN NULL ELSE structural_score END AS score, m IS NOT NULL AS exact, CASE WHEN m IS NOT NULL THEN 1 ELSE cau.neighbors END AS neighbors,
    CASE WHEN m IS NOT NULL THEN 0 ELSE mean_distance END AS mean_distance, coalesce(m, weighted_outcome) AS weighted_outcome, CASE WHEN m IS NOT NULL THEN 0 ELSE dispersion END AS dispersion, coalesce(m, conservative_outcome) AS conservative_outcome
    FROM cur CROSS JOIN ds LEFT JOIN cau ON query = candidate_id AND cau.dataset_id = ds.dataset_id LEFT JOIN measured ON f = cur.semantic_fingerprint AND measured.dataset_id = ds.dataset_id)
  SELECT dataset_id, candidate_id, row_number() OVER (PARTITION BY dataset_id ORDER BY round(conservative_outcome, 9) DESC NULLS LAST, round(weighted_outcome, 9) DESC NULLS LAST, score DESC NULLS LAST, f ASC NULLS FIRST, candidate_id) - 1 AS place,
    exact, CAST(neighbors AS BIGINT) AS neighbors, {estimate}, coalesce(conservative_outcome >= 0, false) AS eligible FROM met"""
    out["feedback_auc"] = """WITH r AS (SELECT confidence AS p, outcome > 0 AS pos FROM feedback_records WHERE outcome IS NOT NULL AND NOT isnan(outcome) AND confidence IS NOT NULL AND NOT isnan(confidence)),
  k AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM r)
  SELECT round((sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) + 0.0 AS auc FROM k"""
    out["feedback_operator_outcomes"] = """WITH r AS (SELECT *, row_number() OVER () AS i FROM feedback_records WHERE outcome BETWEEN -1 AND 1 AND confidence > 0 AND confidence <= 1),
  kv AS (SELECT outcome, confidence, e.key AS k, e.value AS n FROM (SELECT outcome, confidence, unnest(map_entries(features)) AS e FROM r)),
  o AS (SELECT regexp_extract(k, '^operator_(.*)_count$', 1) AS operator, outcome, confidence, n FROM kv WHERE regexp_matches(k, '^operator_.*_count$') AND n IS NOT NULL AND isfinite(n) AND n > 0 AND n < 100000)
  SELECT operator, count(*) AS support, round(sum(outcome * confidence * n) / sum(confidence * n) - (SELECT sum(outcome * confidence) / sum(confidence) FROM r), 6) + 0.0 AS centred FROM o GROUP BY 1"""
    out["transform_counts"] = "SELECT provenance.kind AS kind, count(*) AS n FROM candidates GROUP BY 1"
    bucket = "CASE WHEN nodes <= 5 THEN 0 WHEN nodes <= 12 THEN 1 WHEN nodes <= 24 THEN 2 WHEN nodes <= 48 THEN 3 WHEN nodes <= 96 THEN 4 ELSE 5 END"
    out["elite_round_robin"] = f"""WITH {_CURRENT}, c AS (SELECT candidate_id, structural_score AS s, provenance.kind AS kind, {_TIDY.format('root_family')} AS f, {bucket} AS b, nodes AS n FROM cur WHERE structural_score IS NOT NULL AND NOT isnan(structural_score) AND root_family IS NOT NULL),
  k AS (SELECT *, row_number() OVER w AS rn, first_value(s) OVER w AS hs, first_value(n) OVER w AS hn, first_value(candidate_id) OVER w AS hc FROM c WINDOW w AS (PARTITION BY kind, f, b ORDER BY s DESC, n NULLS FIRST, candidate_id))
  SELECT candidate_id, CAST(row_number() OVER (ORDER BY rn, hs DESC, hn NULLS FIRST, hc) - 1 AS INTEGER) AS place FROM k QUALIFY place < 50"""
    out["field_diversity"] = f"""WITH c AS (SELECT candidate_id, array_to_string(list_sort(list_distinct(coalesce(d.fields, []))), ',') AS f FROM ({_CUR})), k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY candidate_id) AS rn FROM c),
  s AS (SELECT *, sum(CASE WHEN rn <= 2 THEN 1 ELSE 0 END) OVER (ORDER BY candidate_id ROWS UNBOUNDED PRECEDING) AS taken FROM k)
  SELECT candidate_id, CASE WHEN taken - CASE WHEN rn <= 2 THEN 1 ELSE 0 END >= 200 THEN 'remaining' WHEN rn > 2 THEN 'deferred' ELSE 'selected' END AS status FROM s"""
    out["dedup_partition"] = """WITH e AS (SELECT event_id AS position, event_id % 3 AS kind, list_extract(['close', 'open', 'high', 'low', 'volume'], CAST(user_id % 5 + 1 AS BIGINT)) AS f, CAST(event_id % 7 + 2 AS VARCHAR) AS w, event_id % 11 = 0 AS own FROM events),
  o AS (SELECT *, CASE WHEN own THEN f ELSE 'open' END AS g FROM e),
  i AS (SELECT position, kind = 2 AND g = f AS zero, CASE WHEN kind = 0 THEN 'm' || f || w WHEN kind = 1 AND g = f THEN f WHEN kind = 1 THEN 'a' || least(f, g) || greatest(f, g) ELSE 's' || g || f END AS identity FROM o),
  k AS (SELECT *, min(position) OVER (PARTITION BY identity) AS first FROM i)
  SELECT position, CASE WHEN zero THEN 'rejected' WHEN position = first THEN 'accepted' ELSE 'duplicate' END AS status, CASE WHEN zero THEN 'provably_zero' END AS reason, CASE WHEN NOT zero AND position <> first THEN first END AS duplicate_of FROM k"""
    sets = ["operator_shingles", "ordered_paths", "fields", "field_families", "groups", "lineage_parents"]
    weights = {"operator_shingles": 0.24, "ordered_paths": 0.16, "fields": 0.08, "field_families": 0.10, "groups": 0.05, "lineage_parents": 0.05, "operator_histogram": 0.14, "window_buckets": 0.08}
    clean = lambda c: f"list_distinct(list_filter(coalesce({c}, []), lambda v: v IS NOT NULL))"
    part = lambda n: f"{weights[n]} * CASE WHEN len(list_distinct(list_concat(x.{n}, y.{n}))) = 0 THEN 0 ELSE 1 - len(list_intersect(x.{n}, y.{n})) / len(list_distinct(list_concat(x.{n}, y.{n}))) END"
    hist = lambda n: f"""{n}_d AS (SELECT c, sum(abs(l - r)) / nullif(sum(greatest(l, r)), 0) AS d FROM (SELECT c, k, sum(l) AS l, sum(r) AS r FROM (
    SELECT x.candidate_id AS c, e.key AS k, e.value AS l, 0 AS r FROM (SELECT candidate_id, unnest(map_entries(d.{n})) AS e FROM c) x UNION ALL
    SELECT x.candidate_id, e.key, 0, e.value FROM (SELECT c.candidate_id, unnest(map_entries(f.d.{n})) AS e FROM c JOIN f USING (run_id)) x) GROUP BY 1, 2) GROUP BY 1)"""  # noqa: E731
    out["descriptor_distance"] = f"""WITH c AS (SELECT candidate_id, any_value(run_id) AS run_id, any_value(structural_descriptor) AS d FROM candidates WHERE structural_descriptor IS NOT NULL GROUP BY 1),
  f AS (SELECT run_id, arg_min(d, candidate_id) AS d FROM c GROUP BY 1),
  x AS (SELECT candidate_id, run_id, d.nonlinear AS nl, d.conditional AS co, {", ".join(f"{clean('d.' + n)} AS {n}" for n in sets)} FROM c),
  y AS (SELECT run_id, d.nonlinear AS nl, d.conditional AS co, {", ".join(f"{clean('d.' + n)} AS {n}" for n in sets)} FROM f),
  {hist("operator_histogram")}, {hist("window_buckets")}
  SELECT x.candidate_id, round({" + ".join(map(part, sets))} + 0.14 * coalesce(o.d, 0) + 0.08 * coalesce(w.d, 0) + 0.10 * (CAST(coalesce(x.nl, false) <> coalesce(y.nl, false) AS INTEGER) + CAST(coalesce(x.co, false) <> coalesce(y.co, false) AS INTEGER)) / 2, 6) + 0.0 AS d
  FROM x JOIN y USING (run_id) LEFT JOIN operator_histogram_d o ON o.c = x.candidate_id LEFT JOIN window_buckets_d w ON w.c = x.candidate_id"""
    lists = ", ".join(f"list_distinct(list_filter(coalesce(structural_descriptor.{n}, []), lambda v: v IS NOT NULL)) AS {n}" for n in _LISTS)
    out["feedback_features"] = f"""WITH c AS (SELECT row_number() OVER () AS i, candidate_id, root_family, nodes, depth, structural_descriptor AS d, {lists} FROM candidates WHERE structural_descriptor IS NOT NULL), {_features()}
  SELECT candidate_id, feature, value FROM feat JOIN c USING (i)"""
    return out
