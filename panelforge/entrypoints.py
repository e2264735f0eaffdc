"""Queries of the core library and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge import oracle_core, oracle_search, queries_core, queries_search
from panelforge.core import rolling

flagship = queries_core.flagship


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.volume_bursts(_read(spark, sf_dir, "panel_rows"), _read(spark, sf_dir, "panel_datasets"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling.panel_totals(_read(spark, sf_dir, "panel_rows"), _read(spark, sf_dir, "panel_datasets"))
    volume = [(F.round(f"fld_volume_{k}_{p}", 6) + F.lit(0.0)).alias(f"fld_volume_{k}_{p}") for k in ("total", "mean") for p in (7, 30)]
    # in basis points: the data have six digits, so no quotient ends on a half at the sixth digit
    returns = [(F.round(F.col(f"realized_returns_{k}_{p}") * 10000, 6) + F.lit(0.0)).alias(f"returns_bp_{k}_{p}") for k in ("total", "mean") for p in (7, 30)]
    return out.select("dataset_id", "asset", rolling.day_number(F.col("day")).alias("day_no"), *volume, *returns)


_P7 = """WITH ds AS (SELECT dataset_id, ts_unit, make_date(last_day // 10000, last_day // 100 % 100, last_day % 100) AS last_day FROM panel_datasets),
  dated AS (SELECT r.*, d.last_day, CASE ts_unit WHEN 'yyyymmdd' THEN make_date(ts // 10000, ts // 100 % 100, ts % 100)
    WHEN 'epoch_s' THEN DATE '1970-01-01' + CAST(ts // 86400 AS INTEGER) ELSE DATE '1970-01-01' + CAST(ts // 86400000 AS INTEGER) END AS day
    FROM panel_rows r JOIN ds d USING (dataset_id) WHERE asset IS NOT NULL AND ts IS NOT NULL AND bar_no IS NOT NULL),
  cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, asset, ts, bar_no ORDER BY ingested_at DESC NULLS LAST, row_id DESC NULLS LAST) AS rn FROM dated) WHERE rn = 1),
  daily AS (SELECT dataset_id, asset, day, min(last_day) AS last_day, sum(CASE WHEN isfinite(fld_volume) AND fld_volume > 0 THEN fld_volume ELSE 0 END) AS v,
    sum(CASE WHEN isfinite(realized_returns) THEN realized_returns ELSE 0 END) AS r FROM cur GROUP BY 1, 2, 3),
  cal AS (SELECT dataset_id, asset, min(day) AS first_day, min(last_day) AS last_day FROM daily GROUP BY 1, 2),
  days AS (SELECT dataset_id, asset, first_day, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day FROM cal),
  filled AS (SELECT d.dataset_id, d.asset, d.day, date_diff('day', first_day, d.day) + 1 AS i, coalesce(v, 0) AS v, coalesce(r, 0) AS r
    FROM days d LEFT JOIN daily USING (dataset_id, asset, day)),
  roll AS (SELECT dataset_id, asset, CAST(year(day) * 10000 + month(day) * 100 + day(day) AS BIGINT) AS day_no, i, sum(v) OVER w7 AS v7, sum(v) OVER w30 AS v30, sum(r) OVER w7 AS r7, sum(r) OVER w30 AS r30
    FROM filled WINDOW w7 AS (PARTITION BY dataset_id, asset ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY dataset_id, asset ORDER BY day ROWS 29 PRECEDING))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**queries_core.QUERIES, **queries_search.QUERIES, **{f.__name__: f for f in (p7_found, p7_totals)}}


def oracle_sql() -> dict[str, str]:
    return {
        **oracle_core.oracle_sql(),
        **oracle_search.oracle_sql(),
        "p7_found": f"{_P7} SELECT dataset_id, asset, day_no FROM roll WHERE i >= 30 AND 10 * v7 > 7 * v30",
        "p7_totals": f"""{_P7} SELECT dataset_id, asset, day_no, round(v7, 6) + 0.0 AS fld_volume_total_7, round(v30, 6) + 0.0 AS fld_volume_total_30,
  round(r7 * 10000, 6) + 0.0 AS returns_bp_total_7, round(r30 * 10000, 6) + 0.0 AS returns_bp_total_30, round(v7 / least(7, i), 6) + 0.0 AS fld_volume_mean_7,
  round(v30 / least(30, i), 6) + 0.0 AS fld_volume_mean_30, round(r7 / least(7, i) * 10000, 6) + 0.0 AS returns_bp_mean_7, round(r30 / least(30, i) * 10000, 6) + 0.0 AS returns_bp_mean_30 FROM roll""",
    }
