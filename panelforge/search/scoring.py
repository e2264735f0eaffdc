"""Structural scores of candidate pools."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import asdict, dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.expr.descriptor import WEIGHTS as PARTS
from panelforge.expr.descriptor import Descriptor
from panelforge.plans.lineage import cut
from panelforge.plans.numbering import COPIES, numbered_within
from panelforge.plans.workers import ship

ARCHIVE_PEERS, PEERS = 64, 16


@dataclass(frozen=True)
class ScoreWeights:
    simplicity: float = 0.20
    archive_novelty: float = 0.15
    family_diversity: float = 0.10
    lineage_diversity: float = 0.10
    structural_novelty: float = 0.35
    transform_diversity: float = 0.10

    def normalized(self) -> dict[str, float]:
        values = asdict(self)
        total = sum(values.values())
        if any(not math.isfinite(v) or v < 0 for v in values.values()) or total <= 0:
            raise ValueError("weights must be finite, not negative, and not all zero")
        return {k: v / total for k, v in values.items()}


COMPONENTS = tuple(f.name for f in fields(ScoreWeights))


_SETS = ("operator_shingles", "ordered_paths", "fields", "field_families", "groups", "lineage_parents")
_COUNTS = ("operator_histogram", "window_buckets")
_PART_WEIGHTS = tuple(PARTS[n] for n in (*_SETS, *_COUNTS))


class Mask:
    """A descriptor as sets of small numbers, one for each value and n for a count of n: all parts compare alike."""

    __slots__ = ("flags", "parts")
    _numbers: dict[tuple, int] = {}

    def __init__(self, d: Descriptor):
        number = lambda v: self._numbers.setdefault(v, len(self._numbers))
        sets = [frozenset(number((n, v)) for v in getattr(d, n)) for n in _SETS]
        counts = [frozenset(number((n, k, i)) for k, c in getattr(d, n).items() for i in range(c)) for n in _COUNTS]
        self.parts = (*sets, *counts)
        self.flags = d.nonlinear | d.conditional << 1


def mask_distance(a: Mask, b: Mask) -> float:
    """The same as ``descriptor.distance``: what differs over what there is, for sets and counts alike."""
    out = PARTS["flags"] * (a.flags ^ b.flags).bit_count() / 2
    for w, x, y in zip(_PART_WEIGHTS, a.parts, b.parts):
        both = len(x & y)
        union = len(x) + len(y) - both
        if union:
            out += w * (1 - both / union)
    return out if out < 1.0 else 1.0


def nearest_distances(masks: list[Mask], pairs: np.ndarray) -> np.ndarray:
    """For each mask the least distance to those it is paired with (rows of two positions); 1 without a pair.

    Each part is a matrix of bits over the values that occur, so all pairs take a few vector operations.
    """
    n = len(masks)
    i, j = pairs[:, 0], pairs[:, 1]
    flags = np.array([m.flags for m in masks], np.uint8)
    total = PARTS["flags"] * np.bitwise_count(flags[i] ^ flags[j]) / 2
    for p, w in enumerate(_PART_WEIGHTS):
        sizes = np.array([len(m.parts[p]) for m in masks])
        flat = np.fromiter((v for m in masks for v in m.parts[p]), np.int64, int(sizes.sum()))
        values, column = np.unique(flat, return_inverse=True)
        bits = np.zeros((n, -(-max(len(values), 1) // 64) * 64), bool)
        bits[np.repeat(np.arange(n), sizes), column] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        both = np.bitwise_count(words[i] & words[j]).sum(1, dtype=np.int64)
        union = sizes[i] + sizes[j] - both
        total = total + w * np.where(union > 0, 1 - both / np.maximum(union, 1), 0.0)
    out = np.ones(n)
    np.minimum.at(out, i, np.minimum(total, 1.0))
    return out


def peers(i: int, n: int) -> list[int]:
    """Up to 16 others, evenly strided."""
    others = [j for j in range(0, n - 1, max(1, (n - 1) // PEERS))][:PEERS]
    return [j if j < i else j + 1 for j in others]


@lru_cache(maxsize=256)
def peer_pairs(n: int) -> np.ndarray:
    """(i, j) of all ``peers`` of all of n."""
    others = np.arange(0, max(n - 1, 0), max(1, (n - 1) // PEERS))[:PEERS]
    own = np.repeat(np.arange(n), len(others))
    j = np.tile(others, n)
    return np.stack((own, j + (j >= own)), 1)


def components(pool: list[dict], archive: list[Mask]) -> list[dict[str, float]]:
    """The six components of each of a pool of dicts with mask, root_family, operator_count, nodes, parents, kind."""
    families, kinds = Counter(p["root_family"] for p in pool), Counter(p["kind"] for p in pool)
    near, out = archive[:ARCHIVE_PEERS], []
    novelty = nearest_distances([p["mask"] for p in pool], peer_pairs(len(pool))).tolist() if pool else []
    for i, p in enumerate(pool):
        if "archive_novelty" not in p:
            p["archive_novelty"] = min((mask_distance(p["mask"], a) for a in near), default=1.0)
        out.append({
            "simplicity": 1 / (1 + p["operator_count"] + p["nodes"] / 10), "archive_novelty": p["archive_novelty"], "family_diversity": 1 / math.sqrt(families[p["root_family"]]), "lineage_diversity": min(len(set(p["parents"])) / 2, 1.0),
            "structural_novelty": round(novelty[i], 12), "transform_diversity": 1 / math.sqrt(kinds[p["kind"]]),
        })
    return out


def score(parts: dict[str, float], weights: dict[str, float]) -> float:
    return sum(parts[k] * weights[k] for k in COMPONENTS)


def pool_components(df: DataFrame, pool: str | None = None) -> DataFrame:
    """The components that follow from counts, for pools of any size: root_family, kind, nodes, operator_count, parents.

    Each value of the column ``pool`` is a pool of its own, or all rows are one. Counts are aggregated first and joined
    back, so one family may hold any share of the rows.
    """
    by = [pool] if pool else []
    families = df.groupBy(*by, "root_family").agg(F.count("*").alias("__f"))
    kinds = df.groupBy(*by, "kind").agg(F.count("*").alias("__k"))

    def on(c: str) -> Column:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return same & F.col(f"a.{pool}").eqNullSafe(F.col(f"b.{pool}")) if pool else same

    rows = df.alias("a").join(families.alias("b"), on("root_family")).select("a.*", "__f").alias("a").join(kinds.alias("b"), on("kind")).select("a.*", "__f", "__k")
    parents = F.size(F.array_distinct(F.filter(F.coalesce("parents", F.array().cast("array<string>")), lambda v: v.isNotNull())))
    return rows.withColumns({
        "simplicity": 1 / (1 + F.col("operator_count") + F.col("nodes") / 10), "family_diversity": 1 / F.sqrt("__f"), "lineage_diversity": F.least(parents / 2, F.lit(1.0)), "transform_diversity": 1 / F.sqrt("__k"),
    }).drop("__f", "__k")


#: Rows of a pool that one task holds at once.
POOL_ROWS = 20_000


def _parts(d: dict) -> tuple[list[set], int]:
    """The parts of a descriptor read from a table, as sets, with the flags as bits; null parts are empty."""
    sets = [{v for v in d[n] or () if v is not None} for n in _SETS]
    counts = [{(k, i) for k, c in d[n] or () for i in range(c or 0)} for n in _COUNTS]
    return [*sets, *counts], int(bool(d["nonlinear"])) | int(bool(d["conditional"])) << 1


def distances(rows: list[tuple[list[set], int]], others: list[tuple[list[set], int]]) -> np.ndarray:
    """``descriptor.distance`` of each row to each of a few others, by a product of two matrices of 0 and 1 for each part.

    Only values that the others have make columns, so their number is bounded by the others.
    """
    out = np.empty((len(rows), len(others)))
    theirs = np.array([f for _, f in others], np.uint8)
    for a in range(0, len(rows), 2048):
        some = rows[a : a + 2048]
        total = PARTS["flags"] * np.bitwise_count(np.array([f for _, f in some], np.uint8)[:, None] ^ theirs) / 2
        for p, w in enumerate(_PART_WEIGHTS):
            column = {v: i for i, v in enumerate(set().union(*(o[0][p] for o in others)))}
            right = np.zeros((max(len(column), 1), len(others)), np.float32)
            for j, o in enumerate(others):
                right[[column[v] for v in o[0][p]], j] = 1
            left = np.zeros((len(some), max(len(column), 1)), np.float32)
            hits = [(i, column[v]) for i, r in enumerate(some) for v in r[0][p] if v in column]
            if hits:
                left[tuple(np.array(hits).T)] = 1
            both = (left @ right).astype(float)
            union = np.array([len(r[0][p]) for r in some])[:, None] + np.array([len(o[0][p]) for o in others]) - both
            total = total + w * np.where(union > 0, 1 - both / np.maximum(union, 1), 0.0)
        out[a : a + 2048] = np.clip(total, 0.0, 1.0)
    return out


def _least_to_peers(far: np.ndarray, i: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of each row ``i`` the least distance to its ``peers`` among the columns, which are the rows ``at`` of its pool of ``n``."""
    others = np.arange(0, max(n - 1, 0), max(1, (n - 1) // PEERS))[:PEERS]
    if not len(others):
        return np.ones(len(i))
    place = np.full(n, -1, np.int64)
    place[at] = np.arange(len(at))
    peer = others[None, :] + (others[None, :] >= i[:, None])
    return np.take_along_axis(far, place[peer], 1).min(1)


def novelty_components(df: DataFrame, pool: str, order: list[Column], descriptor: str, archive: DataFrame | None = None) -> DataFrame:
    """``df`` with archive_novelty and structural_novelty, for pools of any size: the values of the column ``pool``.

    ``archive``: a table of descriptors ``d`` with ``place``, of which the first 64 count. Structural novelty is the least
    distance to up to 16 peers, evenly strided over the pool in ``order`` (total). All peers of a pool are among 33 of its
    rows, however large it is; each task gets those and a bounded number of the pool's rows. 1 without any.
    """
    rows = cut(numbered_within(df, pool, order, "__i"))
    key = F.col(pool).alias("__p")
    sizes = rows.groupBy(key).agg((F.max("__i") + 1).alias("__n"))
    stride = F.greatest(F.lit(1), F.floor((F.col("__n") - 1) / F.lit(float(PEERS)))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("__c")
    own = rows.withColumn("__copy", F.pmod("__i", F.lit(COPIES)))
    placed = own.join(sizes.select("*", copies), F.col(pool).eqNullSafe(F.col("__p")) & (F.col("__copy") == F.col("__c"))).drop("__p", "__c", "__copy")
    chunk = F.floor(F.col("__i") / F.lit(float(POOL_ROWS))).cast("int")
    heads = placed.filter((F.col("__i") % stride <= 1) & (F.col("__i") <= stride * (PEERS - 1) + 1)).select(
        key, F.col("__i").alias("__at"), F.col(descriptor).alias("__d"), F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / F.lit(float(POOL_ROWS))).cast("int"))).alias("__chunk"))
    known = [] if archive is None else [_parts({n: list(v.items()) if isinstance(v, dict) else v for n, v in r["d"].asDict().items()}) for r in archive.orderBy("place").limit(ARCHIVE_PEERS).select("d").collect()]  # at most 64
    shape = T.StructType([*df.schema.fields, T.StructField("structural_novelty", T.DoubleType()), T.StructField("archive_novelty", T.DoubleType())])

    def run(mine, theirs):  # no hints: Spark would read them as another kind of function
        parts = [_parts(d) for d in mine.column(descriptor).to_pylist()]
        heads_ = [_parts(d) for d in theirs.column("__d").to_pylist()]
        i = mine.column("__i").to_numpy()
        near = _least_to_peers(distances(parts, heads_), i, theirs.column("__at").to_numpy(), mine.column("__n")[0].as_py()) if len(i) else np.empty(0)
        old = distances(parts, known).min(1) if known else np.ones(len(i))
        return mine.select(df_columns).append_column("structural_novelty", pa.array(near, pa.float64())).append_column("archive_novelty", pa.array(old, pa.float64()))

    df_columns = df.columns
    ship(df.sparkSession)
    return placed.withColumn("__chunk", chunk).groupBy(pool, "__chunk").cogroup(heads.groupBy("__p", "__chunk")).applyInArrow(run, shape)


def weighted_score(df: DataFrame, weights: ScoreWeights | None = None) -> DataFrame:
    """``df`` with structural_score, the weighted mean of its six component columns."""
    total = F.lit(0.0)
    for k, w in (weights or ScoreWeights()).normalized().items():
        total = total + F.lit(w) * F.col(k)
    return df.withColumn("structural_score", total)


def ranked(df: DataFrame) -> DataFrame:
    """Score descending, nodes and fingerprint ascending, then candidate_id where there is one, as ``place`` from 1 within the run."""
    order = [F.col("structural_score").isNull(), -F.col("structural_score"), F.col("nodes"), F.col("fingerprint"), *([F.col("candidate_id")] if "candidate_id" in df.columns else [])]
    return numbered_within(df, "run_id", order, "place").withColumn("place", F.col("place") + 1)
