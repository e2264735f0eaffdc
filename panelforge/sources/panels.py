"""Panels from the star-schema tables, and from JSON files."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.panel import DatasetError, Panel, densified
from panelforge.plans.lineage import exists, file_states, new_table_path


_KEPT: dict[tuple, tuple[Panel, str]] = {}

#: Cells of a panel that one bucket is to hold, and the most buckets.
BUCKET_CELLS, MOST_BUCKETS = 500_000, 4096


def kept(spark: SparkSession, sf_dir: str, tables: list[str], make: Callable[[SparkSession, str], Panel]) -> Panel:
    """The panel that ``make`` gives, made once in an application for each state of its files.

    It is a table in the shared folder, in buckets by asset and in them by time, so windows over time need no shuffle. A
    file that has changed, by length or time, or a table that is gone makes a new one.
    """
    state = tuple(file_states(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    key = (spark.sparkContext.applicationId, make.__name__, state)
    if key not in _KEPT or not exists(spark, _KEPT[key][1]):
        panel, path = make(spark, sf_dir), new_table_path(spark, "panel")
        buckets = max(1, min(MOST_BUCKETS, -(-panel.rows * panel.assets // BUCKET_CELLS)))
        name = f"panelforge_{path.rsplit('-', 1)[1]}"
        panel.df.repartition(buckets, "ai").write.bucketBy(buckets, "ai").sortBy("t").option("path", path).saveAsTable(name, format="parquet")
        _KEPT[key] = dataclasses.replace(panel, df=spark.table(name)), path
    return _KEPT[key][0]


def _bars(df: DataFrame, keys: list[str], price: str, order: list[str], volume) -> DataFrame:
    """First, highest, lowest and last price of each key in an order that is total."""
    by = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), volume.cast("double").alias("volume"))


def events_daily(spark: SparkSession, sf_dir: str) -> Panel:
    """``_events_daily``, kept."""
    return kept(spark, sf_dir, ["events"], _events_daily)


def _events_daily(spark: SparkSession, sf_dir: str) -> Panel:
    """Days x event types of the events table; volume is the number of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("day"), F.col("event_type").alias("asset"), "value", "ts", "event_id")
    bars = _bars(e, ["day", "asset"], "value", ["ts", "event_id"], F.count("*"))
    return densified(bars.withColumn("ts", _day_number(F.col("day"))).drop("day"), ["open", "high", "low", "close", "volume"], dataset_id="events-daily", source_label="events")


def _day_number(day):
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("long")


_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def brand_weekly(spark: SparkSession, sf_dir: str) -> Panel:
    """``_brand_weekly``, kept."""
    return kept(spark, sf_dir, ["lineitem", "part"], _brand_weekly)


def _brand_weekly(spark: SparkSession, sf_dir: str) -> Panel:
    """Weeks of shipment x brands; price is extended price by quantity, sector the brand's last digits modulo 5."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_LINE_ORDER)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("asset"))
    x = line.join(part, line.l_partkey == part.p_partkey).withColumn("price", F.try_divide("l_extendedprice", "l_quantity")).withColumn("week", F.to_date(F.date_trunc("week", "l_shipdate")))
    bars = _bars(x, ["week", "asset"], "price", _LINE_ORDER, F.sum("l_quantity"))
    bars = bars.withColumn("ts", _day_number(F.col("week"))).withColumn("grp_sector", F.concat(F.lit("s"), F.pmod(F.substring("asset", 7, 10).cast("int"), F.lit(5)).cast("string")))
    return densified(bars.drop("week"), ["open", "high", "low", "close", "volume"], ["sector"], "brand-weekly", "lineitem")


def supply_monthly(spark: SparkSession, sf_dir: str) -> Panel:
    """``_supply_monthly``, kept."""
    return kept(spark, sf_dir, ["lineitem", "supplier", "nation", "region"], _supply_monthly)


def _supply_monthly(spark: SparkSession, sf_dir: str) -> Panel:
    """Months of shipment x supplier nations; sector is the region."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_LINE_ORDER)
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    s = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("n_name").alias("asset"), F.col("r_name").alias("grp_sector"))
    x = line.join(s, line.l_suppkey == s.s_suppkey).withColumn("price", F.try_divide("l_extendedprice", "l_quantity")).withColumn("month", F.to_date(F.date_trunc("month", "l_shipdate")))
    bars = _bars(x, ["month", "asset", "grp_sector"], "price", _LINE_ORDER, F.sum("l_quantity"))
    return densified(bars.withColumn("ts", _day_number(F.col("month"))).drop("month"), ["open", "high", "low", "close", "volume"], ["sector"], "supply-monthly", "lineitem")


def from_json(spark: SparkSession, text: str) -> Panel:
    """A columnar panel document (schema 1): time-major lists of one value per row and asset."""
    d = json.loads(text)
    if d.get("schema") != 1:
        raise DatasetError(f"unsupported panel schema {d.get('schema')}")
    times, assets = d["timestamps"], d["assets"]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise DatasetError("timestamps must ascend strictly")
    if len(set(assets)) != len(assets):
        raise DatasetError("assets must be distinct")
    columns = {k: v["values"] for k, v in d["fields"].items()} | {"realized_returns": d["realized_returns"]["values"]}
    for k, v in columns.items():
        if len(v) != len(times) * len(assets):
            raise DatasetError(f"column `{k}` has {len(v)} values, expected {len(times) * len(assets)}")
    groups = d.get("groups", {})
    for g, labels in groups.items():
        if len(labels) != len(assets):
            raise DatasetError(f"group `{g}` must have a label for each asset")
    n = len(assets)
    rows = [(i // n, times[i // n], i % n, assets[i % n], *(None if v[i] is None else float(v[i]) for v in columns.values()), *(g[i % n] for g in groups.values())) for i in range(len(times) * n)]
    schema = "t int, ts long, ai int, asset string, " + ", ".join([f"`{k}` double" for k in columns] + [f"`grp_{g}` string" for g in groups])
    return Panel(spark.createDataFrame(rows, schema), tuple(d["fields"]), tuple(groups), len(times), n, d["dataset_id"], d["source_label"], tuple(d.get("preprocessing", ()))).checked()


def to_json(panel: Panel) -> str:
    """The document of ``from_json``; for panels that fit on the driver. Write ``panel.df`` as Parquet otherwise."""
    rows = panel.df.orderBy("t", "ai").toPandas()
    values = lambda c: {"values": [None if v != v or v is None else float(v) for v in rows[c]]}
    first = rows[rows["t"] == 0] if len(rows) else rows
    return json.dumps({
        "schema": 1, "dataset_id": panel.dataset_id, "source_label": panel.source_label, "timestamps": [int(x) for x in rows.drop_duplicates("t")["ts"]], "assets": list(first["asset"]),
        "fields": {f: values(f) for f in panel.fields}, "realized_returns": values("realized_returns"), "groups": {g: list(first[f"grp_{g}"]) for g in panel.groups}, "preprocessing": list(panel.notes),
    })
