"""Exact positions within groups from one global range-partitioned sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.plans.lineage import cut
from panelforge.plans.workers import ship

PID, ORD, SEQ, SUM = "__pf_pid", "__pf_group", "__pf_seq", "__pf_sum"


def _changes(column: pa.Array) -> np.ndarray:
    """For each row but the first: whether it differs from the row before; two nulls are alike."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return np.asarray(pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))).astype(bool)


def _walker(group: list[str], weight: str | None, keep: int | None):
    """Streams one sorted partition: numbers its groups and sums the weights so far, holding one batch at a time."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, ordinal, total, seen = TaskContext.get().partitionId(), None, -1, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in group:
                column = batch.column(batch.schema.get_field_index(g))
                new[1:] |= _changes(column)
            head = tuple(batch.column(batch.schema.get_field_index(g))[0].as_py() for g in group)
            new[0] = last is None or head != last
            last = tuple(batch.column(batch.schema.get_field_index(g))[n - 1].as_py() for g in group)
            w = np.ones(n, np.int64) if weight is None else np.asarray(batch.column(batch.schema.get_field_index(weight))).astype(np.int64)
            run = np.cumsum(w)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            before = np.where(start > 0, run[np.maximum(start - 1, 0)], 0)
            sums = run - before + np.where(start < 0, total, 0)
            ords = ordinal + np.cumsum(new)
            seqs = seen + np.arange(n)
            total, ordinal, seen = int(sums[-1]), int(ords[-1]), seen + n
            columns = [*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(ords.astype(np.int64)), pa.array(seqs.astype(np.int64)), pa.array(sums.astype(np.int64))]
            out = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, PID, ORD, SEQ, SUM])
            yield out if keep is None else out.filter(pa.array(sums <= keep))

    return walk


def positions(df: DataFrame, group: list[str], order: list[Column], out: str, weight: str | None = None, keep: int | None = None) -> DataFrame:
    """Adds to every row of ``df`` the sum of ``weight`` (else the count) over its group up to it, in ``order``.

    One range-partitioned sort on (group, order) puts all rows in one sequence over equally filled partitions, so a
    group that holds a third of all rows lies in many of them. Each partition counts by itself; a group that began in
    an earlier partition gets the count it had there. Only the first group of a partition can have begun before, so one
    number a partition is all that is gathered, whatever the number of rows or groups. With ``keep``, rows beyond that
    position leave in the first pass. ``order`` must be total for the same answer every time. Nulls in group columns
    are one group of their own.
    """
    if out in df.columns:
        raise ValueError(f"the table already has a column `{out}`")
    by = [*(F.col(g).asc() for g in group), *order]
    schema = T.StructType([*df.schema.fields, T.StructField(PID, T.IntegerType()), T.StructField(ORD, T.LongType()), T.StructField(SEQ, T.LongType()), T.StructField(SUM, T.LongType())])
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ship(df.sparkSession)
    rows = cut(sorted_.mapInArrow(_walker(group, weight, keep), schema))
    head = F.struct(SEQ, SUM, ORD, F.struct(*group).alias("g"))
    ends = sorted(rows.groupBy(PID).agg(F.min(head).alias("first"), F.max(head).alias("last")).collect(), key=lambda r: r[PID])  # one row a partition
    carried: list[tuple[int, int]] = []
    open_group, open_sum = None, 0
    for r in ends:
        continues = open_group is not None and r["first"]["g"] == open_group
        if continues:
            carried.append((r[PID], open_sum))
        whole = continues and r["last"]["g"] == open_group
        open_group, open_sum = r["last"]["g"], r["last"][SUM] + (open_sum if whole else 0)
    if not carried:
        return rows.withColumn(out, F.col(SUM)).drop(PID, ORD, SEQ, SUM)
    offsets = df.sparkSession.createDataFrame(carried, f"{PID} int, __pf_before long")
    # at most one row a partition, whatever the data: a proven bound
    joined = rows.join(F.broadcast(offsets), PID, "left")
    value = F.col(SUM) + F.when(F.col(ORD) == 0, F.coalesce("__pf_before", F.lit(0))).otherwise(F.lit(0))
    result = joined.withColumn(out, value).drop(PID, ORD, SEQ, SUM, "__pf_before")
    return result if keep is None else result.filter(F.col(out) <= keep)
