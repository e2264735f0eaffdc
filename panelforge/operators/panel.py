"""Panels: one row for every (time, asset), as all row-based windows need."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.lineage import cut
from panelforge.plans.numbering import numbered_counted

KEYS = ("t", "ts", "ai", "asset")


class DatasetError(ValueError):
    pass


@dataclass(frozen=True)
class Panel:
    """``df`` has t (row, from 0), ts, ai (place of the asset, from 0), asset, the fields, realized_returns, grp_<name>."""

    df: DataFrame
    fields: tuple[str, ...]
    groups: tuple[str, ...] = ()
    rows: int = 0
    assets: int = 0
    dataset_id: str = "panel"
    source_label: str = "unnamed"
    notes: tuple[str, ...] = field(default=())

    def checked(self) -> Panel:
        """Itself, or DatasetError: sizes, one row per cell, finite values, a label for each group and asset.

        One aggregation over the panel; no row leaves the executors.
        """
        if not self.dataset_id.strip() or not self.source_label.strip():
            raise DatasetError("dataset_id and source_label must not be blank")
        if self.rows < 3 or self.assets < 2:
            raise DatasetError("a panel needs at least 3 rows and 2 assets")
        if not self.fields:
            raise DatasetError("a panel needs at least one field")
        bad = [F.count(F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 1)).alias(f"bad_{i}") for i, c in enumerate((*self.fields, "realized_returns"))]
        labels = [F.count(F.when(F.col(f"grp_{g}").isNull() | (F.col(f"grp_{g}") == ""), 1)).alias(f"label_{i}") for i, g in enumerate(self.groups)]
        cells = self.df.groupBy("t", "ai").agg(F.count("*").alias("c"), *bad, *labels)
        r = cells.agg(F.count("*").alias("cells"), F.max("c").alias("most"), F.max("t").alias("t"), F.max("ai").alias("ai"), *(F.sum(c).alias(c) for c in cells.columns if c.startswith(("bad_", "label_")))).first()
        if r["cells"] != self.rows * self.assets or r["most"] != 1 or r["t"] != self.rows - 1 or r["ai"] != self.assets - 1:
            raise DatasetError("the panel must have exactly one row for each time and asset")
        for i, c in enumerate((*self.fields, "realized_returns")):
            if r[f"bad_{i}"]:
                raise DatasetError(f"column `{c}` contains a non-finite value")
        for i, g in enumerate(self.groups):
            if r[f"label_{i}"]:
                raise DatasetError(f"group `{g}` must have a label for each asset")
        return self

    def by_asset(self, partitions: int | None = None) -> Panel:
        """The panel hash-partitioned by asset and cached, for many evaluations over it."""
        df = (self.df.repartition(partitions, "ai") if partitions else self.df.repartition("ai")).persist()
        return Panel(df, self.fields, self.groups, self.rows, self.assets, self.dataset_id, self.source_label, self.notes)


def densified(observed: DataFrame, fields: list[str], groups: list[str] | None = None, dataset_id: str = "panel", source_label: str = "unnamed", returns: str | None = None, group_table: DataFrame | None = None) -> Panel:
    """A panel from observed cells ``(ts, asset, fields..., [realized_returns])``, at most one row per cell.

    Every time with a row meets every asset with a row (null keys are left out); cells without one are null. Times and assets are numbered in
    ascending order. realized_returns is ``returns`` where named, else the change of close over the row before. Labels of
    ``groups`` come from ``group_table`` (asset, grp_...), one row per asset, else from ``observed`` (any one label).

    Each asset is written out over all times, which is what a dense panel is; then the cells are joined by key.
    """
    groups = groups or []
    observed = cut(observed)  # read several times below
    times, rows = numbered_counted(observed.select("ts").filter("ts is not null").distinct(), "ts", "t")
    names, assets = numbered_counted(observed.select("asset").filter("asset is not null").distinct(), "asset", "ai")
    times, names = (df.withColumn(c, F.col(c).cast("int")) for df, c in ((times, "t"), (names, "ai")))
    if groups:
        labels = group_table if group_table is not None else observed.groupBy("asset").agg(*(F.min(f"grp_{g}").alias(f"grp_{g}") for g in groups))
        names = names.join(labels.select("asset", *(f"grp_{g}" for g in groups)), "asset", "left")
    grid = names.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(max(rows - 1, 0))))).join(times, "t")
    extra = ["realized_returns"] if returns is None and "realized_returns" in observed.columns else []
    df = grid.join(observed.select("ts", "asset", *fields, *extra), ["ts", "asset"], "left")
    if returns is not None:
        df = df.withColumn("realized_returns", F.col(returns))
    elif not extra:
        before = F.lag("close").over(Window.partitionBy("ai").orderBy("t"))
        df = df.withColumn("realized_returns", F.try_divide("close", before) - 1)
    if "returns" not in fields and "close" in fields:
        df = df.withColumn("returns", F.col("realized_returns"))
        fields = [*fields, "returns"]
    return Panel(df.select(*KEYS, *fields, "realized_returns", *(f"grp_{g}" for g in groups)), tuple(fields), tuple(groups), rows, assets, dataset_id, source_label)
