"""Rarity order and prefixes of token sets, shared by the set join and the record linkage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.plans.workers import ship

#: Counters of the rarity table. Every token of every row is counted, in the counter that its hash falls into, so the
#: table has a fixed size (8 MB) at any data size. Sharing a counter can only make a token look more frequent, which
#: changes the order of tokens and so the speed, never the result: any one order of all tokens is right.
COUNTERS = 1 << 20

#: Rows of one index list that one task meets; longer lists are split over salts.
LIST_ROWS = 20_000


def rarity_counts(tokens: DataFrame, column: str, counters: int = COUNTERS) -> np.ndarray:
    """How many rows have a token of each counter, over all rows of ``tokens[column]`` (array<long>)."""
    slot = F.explode(F.transform(column, lambda t: F.pmod(t, F.lit(counters)).cast("int"))).alias("slot")
    rows = tokens.select(slot).groupBy("slot").agg(F.count("*").alias("n")).toArrow()  # at most one row a counter
    out = np.zeros(counters, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def least_overlap(threshold: float, n: int) -> int:
    """The smallest integer overlap o with o >= threshold * n, safe from rounding."""
    return max(1, math.ceil(round(threshold * n, 9)))


def with_prefixes(df: DataFrame, tokens: str, counts: np.ndarray, threshold: float, list_rows: int = LIST_ROWS, totals: np.ndarray | None = None) -> DataFrame:
    """Sorts ``tokens`` by (count, token), rarest first, and adds ``salts``, ``b1`` and ``b2``.

    Two sets with Jaccard of at least the threshold share a token of their prefixes, the first n - ceil(threshold n) + 1
    tokens. ``salts`` has an element for each of these: into how many parts the list of that token is to be split, by
    ``totals`` where these differ from the counts that make the order.
    (b1, b2) have a bit set for each token, by its hash: two sets differ in at least as many tokens as their bits do.
    """
    added = [T.StructField("salts", T.ArrayType(T.IntegerType())), T.StructField("b1", T.LongType()), T.StructField("b2", T.LongType())]
    schema = T.StructType([*df.schema.fields, *added])
    at = df.columns.index(tokens)
    size = len(counts)
    shared = df.sparkSession.sparkContext.broadcast((counts, counts if totals is None else totals))  # fixed size, see COUNTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows_of = shared.value
        for batch in batches:
            column = batch.column(at)
            flat = np.asarray(column.flatten())
            lengths = np.diff(np.asarray(column.offsets)).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            flat = flat[np.lexsort((flat, table[np.mod(flat, size)], row))]
            need = np.array([least_overlap(threshold, int(n)) if n else 1 for n in lengths], np.int64)
            take = np.where(lengths > 0, lengths - need + 1, 0)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            place = np.arange(len(flat)) - np.repeat(starts[:-1], lengths)
            inside = place < np.repeat(take, lengths)
            parts = np.maximum(1, -(-rows_of[np.mod(flat[inside], size)] // list_rows)).astype(np.int32)
            salts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32)), pa.array(parts))
            bit = (flat >> 32) & 127
            bits = np.zeros((2, batch.num_rows), np.uint64)
            np.bitwise_or.at(bits, (bit >> 6, row), np.uint64(1) << (bit & 63).astype(np.uint64))
            sorted_ = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
            columns = [sorted_ if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, salts, *(pa.array(b.view(np.int64)) for b in bits)], names=[*batch.schema.names, "salts", "b1", "b2"])

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def key_rows(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One narrow row per token of each prefix: k1, k2, n, b1, b2, token, place, salts."""
    rows = df.select("k1", "k2", "n", "b1", "b2", tokens, F.posexplode("salts").alias("place", "salts"))
    return rows.select("k1", "k2", "n", "b1", "b2", F.get(tokens, F.col("place")).alias("token"), "place", "salts")


def possible(threshold: float) -> Column:
    """Length, positional and bit filters between key rows aliased ``a`` and ``b`` that have met by one token.

    overlap >= t * union is overlap >= t / (1 + t) * (na + nb): the sizes must not be too far apart, the tokens from the
    one met on must be enough, and the bits must not differ in more places than the sets may differ in tokens.
    """
    na, nb = F.col("a.n"), F.col("b.n")
    need = F.ceil(F.round(F.lit(threshold / (1 + threshold)) * (na + nb), 9))
    at_most = F.lit(1) + F.least(na - F.col("a.place") - 1, nb - F.col("b.place") - 1)
    apart = F.bit_count(F.col("a.b1").bitwiseXOR(F.col("b.b1"))) + F.bit_count(F.col("a.b2").bitwiseXOR(F.col("b.b2")))
    return (F.least(na, nb) >= F.round(F.lit(threshold) * F.greatest(na, nb), 9)) & (at_most >= need) & (apart <= na + nb - 2 * need)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float, own: DataFrame | None = None) -> DataFrame:
    """a1, a2, b1, b2, similarity of those pairs of sets whose exact overlap is enough.

    ``sets``: k1, k2, n, tokens of all; ``own`` of those that stand first in a pair, where they are fewer.
    """
    a = (sets if own is None else own).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    overlap = F.size(F.array_intersect("ta", "tb"))
    return both.select("a1", "a2", "b1", "b2", (overlap / (F.col("na") + F.col("nb") - overlap)).alias("similarity")).filter(F.round("similarity", 12) >= threshold)
