"""Long windows whose order or ranks count, as vectorised kernels over chunks of each asset's rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.plans.workers import ship

#: Windows up to this many rows are lists within the JVM; longer ones come here.
SHORT = 16

#: Rows of an asset that one task holds at once; the rows before that a window reaches back to are sent along.
CHUNK = 1 << 16

#: Windows unrolled at once.
_BLOCK = 1 << 21


def weights_of(name: str, w: int) -> np.ndarray | None:
    """Oldest first; None for kernels that don't weigh."""
    if name == "ts_wma":
        return np.arange(w, dtype=float)
    if name == "decay":
        return np.arange(1.0, w + 1)
    if name == "ts_ema":
        alpha = 1 - 2 / (1 + w)
        return alpha ** (w - np.arange(w, dtype=float))
    return None


KERNELS = frozenset(["ts_median", "ts_mad", "ts_rank", "ts_wma", "ts_ema", "decay"])


def rolled(name: str, x: np.ndarray, missing: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Values, and where there is none: the window isn't full or a value in it is missing."""
    n = len(x)
    out, none = np.zeros(n), np.ones(n, bool)
    if n < w:
        return out, none
    counts = np.concatenate(([0], np.cumsum(missing)))
    none[w - 1 :] = counts[w:] - counts[:-w] > 0
    weights = weights_of(name, w)
    windows = np.lib.stride_tricks.sliding_window_view(x, w)
    step = max(1, _BLOCK // w)
    for a in range(0, len(windows), step):
        v = windows[a : a + step]
        if weights is not None:
            r = v @ weights / weights.sum()
        elif name == "ts_median":
            r = np.sort(v, axis=1)[:, (w - 1) // 2]
        elif name == "ts_mad":
            r = np.abs(v - v.mean(1, keepdims=True)).mean(1)
        else:
            whole = np.where(np.isnan(v), np.inf, v)  # NaN is above all others and as large as itself
            r = ((whole <= whole[:, -1:]).sum(1) - 1) / max(w - 1, 1)
        out[w - 1 + a : w - 1 + a + len(v)] = r
    return out, none


def with_kernels(df: DataFrame, asked: dict[str, tuple[str, str, int]], chunk: int = CHUNK) -> DataFrame:
    """``df`` with a column for each of ``asked``: kernel, input column, rows of the window.

    Every asset's rows are cut into chunks; the last rows of a chunk that windows of the next reach back to go to both,
    so an asset of any length is worked on by many tasks.
    """
    reach = max(w for _, _, w in asked.values()) - 1
    if reach >= chunk:
        raise ValueError("windows must be shorter than a chunk")
    own = F.floor(F.col("t") / F.lit(float(chunk))).cast("int")
    late = F.pmod("t", F.lit(chunk)) >= chunk - reach
    rows = df.withColumn("__chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in asked)])

    def run(key, table):  # no hints: Spark would read them as another kind of function
        table = table.combine_chunks().sort_by("t")
        kept = table.column("t").to_numpy() // chunk == key[1].as_py()
        out = table.drop_columns(["__chunk"])
        for c, (name, source, w) in asked.items():
            column = table.column(source).combine_chunks()
            missing = np.asarray(column.is_null())
            x = np.where(missing, 0.0, np.asarray(column.fill_null(0.0), dtype=float))
            values, none = rolled(name, x, missing, w)
            out = out.append_column(c, pa.array(values, pa.float64(), mask=none))
        return out.filter(pa.array(kept))

    ship(df.sparkSession)
    return rows.groupBy("ai", "__chunk").applyInArrow(run, schema)
