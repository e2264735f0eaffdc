"""Panels with a universe chosen anew each day, from Hive-partitioned Parquet tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators.panel import DatasetError, Panel, densified

NOTES = (
    "each date selects its universe by positive finite market value of the same day",
    "returns are changes of the adjusted close of each ticker",
    "prices are adjusted by closeadj / close; volume is as given",
    "signal fields are null outside the day's universe",
    "realized returns stay for targets after a ticker has left",
    "nothing is filled forward; there are no static labels",
)

_DAILY = {"ticker": "string", "date": "date", "marketcap": "double"}
_STOCKS = {"ticker": "string", "date": "date", **dict.fromkeys(["closeadj", "close", "open", "high", "low", "volume"], "double")}


@dataclass(frozen=True)
class UniverseConfig:
    start: dt.date
    end: dt.date
    size: int
    dataset_id: str = "universe"

    def checked(self) -> UniverseConfig:
        if self.start > self.end or self.size < 2 or not self.dataset_id.strip():
            raise DatasetError("ordered dates, a universe of at least 2 and a dataset id are required")
        return self


def read_years(spark: SparkSession, root: str, table: str, first: int, last: int) -> DataFrame:
    """``root/table/partition_year=YYYY/*.parquet`` of those years; a missing or empty year is an error.

    Only the years' folders are listed. Column types must be exactly those expected.
    """
    base = f"{root.rstrip('/')}/{table}"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for year in range(first, last + 1):
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/partition_year={year}")
        fs = path.getFileSystem(conf)
        if not fs.exists(path) or not any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(path)):
            raise DatasetError(f"no Parquet files in {base}/partition_year={year}")
    df = spark.read.option("basePath", base).parquet(*(f"{base}/partition_year={y}" for y in range(first, last + 1)))
    types = dict(df.dtypes)
    for column, kind in (_DAILY if table == "daily" else _STOCKS).items():
        if types.get(column) != kind:
            raise DatasetError(f"{table}.{column} must be {kind}, not {types.get(column)}")
    return df


def universe_members(daily: DataFrame, config: UniverseConfig) -> DataFrame:
    """date, ticker, marketcap: of each date the ``size`` largest, ties by ticker. A repeated ticker has its largest value."""
    m = F.col("marketcap")
    good = F.col("ticker").isNotNull() & F.col("date").between(config.start, config.end) & (m > 0) & ~F.isnan(m) & (m != float("inf"))
    one = daily.filter(good).groupBy("date", "ticker").agg(F.max("marketcap").alias("marketcap"))
    w = Window.partitionBy("date").orderBy(F.col("marketcap").desc(), F.col("ticker").asc())
    return one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= config.size).drop("rn")


def adjusted_prices(stocks: DataFrame, members: DataFrame, config: UniverseConfig, order: list[str] | None = None) -> DataFrame:
    """date, ticker, open, high, low, close (adjusted), volume, realized_returns of every ticker ever in the universe.

    Rows need all values, prices above 0 and finite, a volume of at least 0. Of several rows of a ticker and date the
    first by ``order`` (of columns) counts: by default the first in file order. Returns are over the ticker's own rows,
    also those of dates that the universe lacks.
    """
    numbers = [c for c, k in _STOCKS.items() if k == "double"]
    where = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")] if order is None else [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    rows = stocks.select("ticker", "date", *numbers, *where).dropna(subset=["ticker", "date", *numbers]).filter(F.col("date").between(config.start, config.end))
    rows = rows.join(members.select("ticker").distinct(), "ticker", "left_semi")
    factor = F.try_divide("closeadj", "close")
    rows = rows.withColumns({c: F.col(c) * factor for c in ("open", "high", "low")}).withColumn("close", F.col("closeadj"))
    finite = F.lit(True)
    for c in ("open", "high", "low", "close"):
        finite = finite & (F.col(c) > 0) & ~F.isnan(c) & (F.col(c) != float("inf"))
    finite = finite & (F.col("volume") >= 0) & ~F.isnan("volume") & (F.col("volume") != float("inf"))
    first = Window.partitionBy("ticker", "date").orderBy(*(["__file", "__row"] if order is None else [f"__o{i}" for i in range(len(order))]))
    rows = rows.filter(finite).withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    change = F.try_divide("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1
    usable = F.when(~F.isnan(change) & (F.abs(change) != float("inf")), change)
    return rows.withColumn("realized_returns", usable).select("date", "ticker", "open", "high", "low", "close", "volume", "realized_returns")


def universe_cells(members: DataFrame, prices: DataFrame) -> DataFrame:
    """ts, asset, fields and realized_returns at the dates of the universe; fields only where the ticker was a member."""
    dates = members.select("date").distinct()
    inside = members.select("date", "ticker", F.lit(True).alias("member"))
    rows = prices.join(dates, "date", "left_semi").join(inside, ["date", "ticker"], "full")
    fields = {c: F.when(F.col("member"), F.col(c)) for c in ("open", "high", "low", "close", "volume")}
    ts = (F.year("date") * 10000 + F.month("date") * 100 + F.dayofmonth("date")).cast("long")
    return rows.select(ts.alias("ts"), F.col("ticker").alias("asset"), *(e.alias(c) for c, e in fields.items()), F.when(F.col("member"), F.col("realized_returns")).alias("returns"), "realized_returns")


def panel_from_tables(daily: DataFrame, stocks: DataFrame, config: UniverseConfig, order: list[str] | None = None) -> Panel:
    members = universe_members(daily, config.checked())
    cells = universe_cells(members, adjusted_prices(stocks, members, config, order))
    label = f"universe of {config.size} by same-day market value, {config.start}..{config.end}"
    panel = densified(cells, ["open", "high", "low", "close", "volume", "returns"], dataset_id=config.dataset_id, source_label=label)
    if panel.rows < 3 or panel.assets < 2:
        raise DatasetError("the range must hold at least three dates and two assets")
    return Panel(panel.df, panel.fields, (), panel.rows, panel.assets, panel.dataset_id, panel.source_label, NOTES)


def prepare(spark: SparkSession, root: str, config: UniverseConfig) -> Panel:
    config.checked()
    years = (config.start.year, config.end.year)
    return panel_from_tables(read_years(spark, root, "daily", *years), read_years(spark, root, "stocks", *years), config)


def first_row_on_or_after(panel: Panel, day: dt.date) -> int | None:
    number = day.year * 10000 + day.month * 100 + day.day
    return panel.df.filter(F.col("ts") >= number).agg(F.min("t")).first()[0]
