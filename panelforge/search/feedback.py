"""Guidance from measured outcomes: features, neighbours, estimates, audits, operator policy."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.expr.catalog import Catalog
from panelforge.expr.descriptor import Descriptor
from panelforge.plans.numbering import running_sum
from panelforge.plans.workers import ship

# Operators counted by feature, operator families, plain features, and bucket numbers of the hashed features.
COUNTED = (
    "abs", "add", "divide", "multiply", "rank", "sign", "subtract", "ts_corr", "ts_cov", "ts_delay", "ts_delta", "ts_ema", "ts_kurt", "ts_mad", "ts_max", "ts_mean", "ts_min", "ts_rank", "ts_skew", "ts_std_dev", "ts_sum",
    "ts_var", "ts_wma",
)
FAMILIES = {
    "arithmetic": ("add", "divide", "multiply", "negate", "subtract"),
    "conditional": ("greater", "if_else"),
    "cross_sectional": ("group_rank", "rank", "zscore"),
    "preprocess": ("clip", "winsorize"),
    "time_series": (
        "ts_corr", "ts_cov", "ts_delay", "ts_delta", "ts_ema", "ts_kurt", "ts_mad", "ts_max", "ts_mean", "ts_median", "ts_min", "ts_rank", "ts_skew", "ts_std_dev", "ts_sum", "ts_var", "ts_wma", "ts_zscore",
    ),
}
PLAIN = (
    "conditional", "depth", "field_count", "field_family_count", "group_count", "lineage_parent_count", "nodes", "nonlinear", "operator_count", "window_long_count", "window_medium_count", "window_short_count", "window_total_count",
)
FAMILY_BUCKETS, FIELD_BUCKETS, INTERACTION_BUCKETS = 8, 16, 32

FEATURES = frozenset([
    *PLAIN, *(f"operator_{k}_count" for k in [*FAMILIES, *COUNTED]), *(f"field_family_bucket_{i}_count" for i in range(FAMILY_BUCKETS)),
    *(f"field_{FIELD_BUCKETS}_bucket_{i}_count" for i in range(FIELD_BUCKETS)), *(f"interaction_{INTERACTION_BUCKETS}_bucket_{i}_count" for i in range(INTERACTION_BUCKETS)),
])

#: Rows of a block of candidates or records; two blocks meet in one task.
BLOCK = 4096


class FeedbackError(ValueError):
    pass


def _bucket(text: str, n: int) -> int:
    return hashlib.sha256(text.encode()).digest()[0] % n


def features(d: Descriptor, root_family: str, nodes: int, depth: int) -> dict[str, float]:
    """The structural features of one formula; all of FEATURES."""
    ops, windows = d.operator_histogram, d.window_buckets
    out = dict.fromkeys(FEATURES, 0.0)
    out |= {
        "conditional": float(d.conditional), "depth": float(depth), "field_count": float(len(d.fields)), "field_family_count": float(len(d.field_families)), "group_count": float(len(d.groups)),
        "lineage_parent_count": float(len(d.lineage_parents)), "nodes": float(nodes), "nonlinear": float(d.nonlinear), "operator_count": float(sum(ops.values())), "window_total_count": float(sum(windows.values())),
    }
    out |= {f"window_{w}_count": float(windows.get(w, 0)) for w in ("long", "medium", "short")}
    out |= {f"operator_{k}_count": float(sum(ops.get(o, 0) for o in v)) for k, v in FAMILIES.items()}
    out |= {f"operator_{o}_count": float(ops.get(o, 0)) for o in COUNTED}
    hashed = [(f"field_family_bucket_{_bucket(x, FAMILY_BUCKETS)}_count", 1) for x in d.field_families]
    hashed += [(f"field_{FIELD_BUCKETS}_bucket_{_bucket(x, FIELD_BUCKETS)}_count", 1) for x in d.fields]
    tokens = [(f"root_field:{root_family}:{f}", 1) for f in d.fields] + [(f"operator_field:{o}:{f}", n) for f in d.fields for o, n in ops.items()]
    tokens += [(f"operator_window:{o}:{w}", n * m) for o, n in ops.items() for w, m in windows.items()] + [(f"operator_shingle:{s}", 1) for s in d.operator_shingles]
    hashed += [(f"interaction_{INTERACTION_BUCKETS}_bucket_{_bucket(x, INTERACTION_BUCKETS)}_count", n) for x, n in tokens]
    for name, n in hashed:
        out[name] += n
    return out


def feature_map(descriptor: str, root_family: str, nodes: str, depth: str) -> Column:
    """``features`` of every row of a candidates table, within the JVM, as map<string,double>."""
    names, values = feature_values(descriptor, root_family, nodes, depth)
    return F.map_from_arrays(F.lit(names), values)


def feature_values(descriptor: str, root_family: str, nodes: str, depth: str) -> tuple[list[str], Column]:
    """The names of ``feature_map`` and its values as an array."""
    d = lambda n: F.col(f"{descriptor}.{n}")
    texts = lambda n: F.array_sort(F.array_distinct(F.filter(F.coalesce(d(n), F.array().cast("array<string>")), lambda v: v.isNotNull())))
    ops = F.coalesce(d("operator_histogram"), F.create_map().cast("map<string,int>"))
    windows = F.coalesce(d("window_buckets"), F.create_map().cast("map<string,int>"))
    count = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).cast("double")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0)))
    values: dict[str, Column] = {
        "conditional": F.coalesce(d("conditional"), F.lit(False)).cast("double"), "nonlinear": F.coalesce(d("nonlinear"), F.lit(False)).cast("double"), "depth": F.col(depth).cast("double"), "nodes": F.col(nodes).cast("double"),
        "field_count": F.size(texts("fields")), "field_family_count": F.size(texts("field_families")), "group_count": F.size(texts("groups")), "lineage_parent_count": F.size(texts("lineage_parents")),
        "operator_count": total(ops), "window_total_count": total(windows), **{f"window_{w}_count": count(windows, w) for w in ("long", "medium", "short")},
    }
    for k, names in FAMILIES.items():
        values[f"operator_{k}_count"] = sum((count(ops, o) for o in names[1:]), count(ops, names[0]))
    values |= {f"operator_{o}_count": count(ops, o) for o in COUNTED}
    ones = lambda xs, prefix="": F.transform(xs, lambda x: F.struct(F.concat(F.lit(prefix), x).alias("x"), F.lit(1).alias("n")))
    o, w = F.map_entries(ops), F.map_entries(windows)
    root = F.coalesce(F.col(root_family), F.lit(""))
    tokens = F.concat(
        F.transform(texts("fields"), lambda f: F.struct(F.concat(F.lit("root_field:"), root, F.lit(":"), f).alias("x"), F.lit(1).alias("n"))),
        F.flatten(F.transform(texts("fields"), lambda f: F.transform(o, lambda e: F.struct(F.concat(F.lit("operator_field:"), e["key"], F.lit(":"), f).alias("x"), e["value"].alias("n"))))),
        F.flatten(F.transform(o, lambda e: F.transform(w, lambda v: F.struct(F.concat(F.lit("operator_window:"), e["key"], F.lit(":"), v["key"]).alias("x"), (e["value"] * v["value"]).alias("n"))))),
        ones(texts("operator_shingles"), "operator_shingle:"),
    )
    names = [*values]
    parts = [F.array(*(v.cast("double") for v in values.values()))]
    for prefix, n, items in (("field_family_bucket", FAMILY_BUCKETS, ones(texts("field_families"))), (f"field_{FIELD_BUCKETS}_bucket", FIELD_BUCKETS, ones(texts("fields"))), (f"interaction_{INTERACTION_BUCKETS}_bucket", INTERACTION_BUCKETS, tokens)):
        parts.append(_bucket_counts(_placed(items, n), n))
        names += [f"{prefix}_{i}_count" for i in range(n)]
    return names, F.concat(*parts)


def _placed(items: Column, n: int) -> Column:
    return F.transform(items, lambda e: F.struct((F.conv(F.substring(F.sha2(e["x"], 256), 1, 2), 16, 10).cast("int") % F.lit(n)).alias("b"), e["n"].alias("n")))


def _bucket_counts(placed: Column, n: int) -> Column:
    """The sum of each bucket. The array is bound to a variable first, as an expression would be evaluated again for every bucket."""
    sums = lambda p: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.filter(p, lambda e: e["b"] == i), F.lit(0.0), lambda a, e: a + F.coalesce(e["n"], F.lit(0))))
    return F.element_at(F.transform(F.array(placed), sums), 1)


@dataclass(frozen=True)
class Record:
    record_id: str
    features: dict[str, float]
    outcome: float
    confidence: float
    semantic_fingerprint: str | None = None


@dataclass(frozen=True)
class FeedbackDataset:
    dataset_id: str
    context_checksum: str
    outcome_label: str
    feature_scales: dict[str, float]
    records: tuple[Record, ...]

    def checked(self) -> FeedbackDataset:
        if not self.dataset_id.strip() or not self.outcome_label.strip() or not self.feature_scales or not self.records:
            raise FeedbackError("a feedback dataset needs an id, a label, scales and records")
        if not set(self.feature_scales) <= FEATURES or any(not (math.isfinite(s) and s > 0) for s in self.feature_scales.values()):
            raise FeedbackError("feature scales must be positive numbers of known features")
        ids, prints = set(), set()
        for r in self.records:
            if not r.record_id.strip() or r.record_id in ids or (r.semantic_fingerprint and r.semantic_fingerprint in prints):
                raise FeedbackError(f"blank or repeated record `{r.record_id}`")
            ids.add(r.record_id)
            prints.add(r.semantic_fingerprint)
            if set(r.features) != set(self.feature_scales) or any(not math.isfinite(v) for v in r.features.values()):
                raise FeedbackError(f"record `{r.record_id}` must have exactly the scaled features")
            if not (-1 <= r.outcome <= 1 and 0 < r.confidence <= 1):
                raise FeedbackError(f"outcome or confidence of `{r.record_id}` is out of range")
        return self

    @property
    def checksum(self) -> str:
        rows = sorted(json.dumps(dataclasses.asdict(r), sort_keys=True) for r in self.records)
        return hashlib.sha256(json.dumps([self.dataset_id, self.context_checksum, self.outcome_label, sorted(self.feature_scales.items()), rows]).encode()).hexdigest()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.record_id, r.semantic_fingerprint, [float(r.features[k]) for k in sorted(self.feature_scales)], float(r.outcome), float(r.confidence)) for r in self.records]
        return spark.createDataFrame(rows, "id string, fingerprint string, vec array<double>, outcome double, confidence double")

    @property
    def scales(self) -> list[float]:
        return [float(self.feature_scales[k]) for k in sorted(self.feature_scales)]

    @staticmethod
    def from_json(text: str) -> FeedbackDataset:
        d = json.loads(text)
        if d.get("schema") != 1:
            raise FeedbackError(f"unsupported feedback schema {d.get('schema')}")
        records = tuple(Record(r["record_id"], dict(r["features"]), r["outcome"], r["confidence"], r.get("semantic_fingerprint")) for r in d["records"])
        return FeedbackDataset(d["dataset_id"], d["context_checksum"], d["outcome_label"], dict(d["feature_scales"]), records).checked()


@dataclass(frozen=True)
class FeedbackConfig:
    neighbors: int = 8
    minimum_neighbors: int = 3
    maximum_distance: float = 1.0

    def checked(self) -> FeedbackConfig:
        if not (1 <= self.neighbors <= 10_000 and 1 <= self.minimum_neighbors <= self.neighbors and 0 <= self.maximum_distance <= 1):
            raise FeedbackError("neighbors 1..10000, minimum_neighbors within them and maximum_distance 0..1 are required")
        return self


#: Of each dataset, the scales in the order of its vectors, and its config.
Guides = dict[str, tuple[list[float], FeedbackConfig]]
_ONE = "__pf_all"


def _alone(df: DataFrame) -> DataFrame:
    return df.withColumn("dataset_id", F.lit(_ONE))


def neighbours(queries: DataFrame, records: DataFrame, scales: list[float], config: FeedbackConfig, leave_one_out: bool = False, block: int = BLOCK) -> DataFrame:
    """``neighbours_by_dataset`` of one dataset: query, record, distance, outcome, confidence, place."""
    return neighbours_by_dataset(_alone(queries), _alone(records), {_ONE: (scales, config)}, leave_one_out, block).drop("dataset_id")


def _nearest(x: np.ndarray, y: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None, scale: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of y and distances of the k nearest of each row within ``most``; ties by row. same: codes of the rows, equal ones do not meet."""
    columns, rows, near, found = np.ascontiguousarray(y.T), [], [], []
    step = max(1, 2**15 // max(1, len(y)))
    for at in range(0, len(x) if len(y) else 0, step):
        part = x[at : at + step]
        d, one = np.zeros((len(part), len(y))), np.empty((len(part), len(y)))
        for f, s in enumerate(scale):
            np.subtract(columns[f], part[:, f, None], out=one)
            np.abs(one, out=one)
            np.divide(one, s, out=one)
            np.minimum(one, 1.0, out=one)
            d += one
        d /= len(scale)
        if same is not None:
            d[same[0][at : at + step, None] == same[1]] = np.inf
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(y) else np.full(len(part), np.inf)
        i, j = np.nonzero(d <= np.minimum(bound, most)[:, None])
        order = np.lexsort((j, d[i, j], i))
        i, j = i[order], j[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[keep], j[keep]
        rows.append(i + at)
        near.append(j)
        found.append(d[i, j])
    whole = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
    return whole(rows, np.int64), whole(near, np.int64), whole(found, np.float64)


def neighbours_by_dataset(queries: DataFrame, records: DataFrame, guides: Guides, leave_one_out: bool = False, block: int = BLOCK) -> DataFrame:
    """dataset_id, query, record, distance, outcome, confidence, place of the nearest records of the query's dataset within its maximum distance, ties by record.

    ``queries``: dataset_id, id, vec; ``records``: dataset_id, id, vec, outcome, confidence; rows of datasets without a guide
    are left out. Distance is the mean of min(|difference| / scale, 1). Both sides of a dataset are cut into blocks by hash;
    each pair of blocks is one group of bounded memory, which gives the k nearest of each of its queries, and the best k of
    all blocks remain. ``leave_one_out`` leaves out the record of the same id.
    """
    spark = queries.sparkSession
    ship(spark)
    guide = {d: (np.array(scales, dtype=float), config.checked().neighbors, config.maximum_distance) for d, (scales, config) in guides.items()}
    counted = lambda df: {r["dataset_id"]: r["n"] for r in df.groupBy("dataset_id").agg(F.count("*").alias("n")).collect()}  # noqa: E731  # one row a dataset
    n, m = counted(queries), counted(records)
    cuts = [(d, -(-n[d] // block), -(-m[d] // block), guide[d][1]) for d in guide if d in n and d in m]
    sizes = F.broadcast(spark.createDataFrame(cuts, "dataset_id string, a int, b int, k int"))  # one row a dataset
    none = F.lit(None).cast("double")
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    q = queries.join(sizes, "dataset_id").select("dataset_id", F.col("id").cast("string").alias("id"), "vec", none.alias("outcome"), none.alias("confidence"), F.lit(0).alias("side"), own("a").alias("qb"), each("b").alias("rb"))
    r = records.join(sizes, "dataset_id").select("dataset_id", F.col("id").cast("string").alias("id"), "vec", "outcome", "confidence", F.lit(1).alias("side"), each("a").alias("qb"), own("b").alias("rb"))

    def meet(table):
        table = table.combine_chunks().sort_by("id")
        scale, k, most = guide[table.column("dataset_id")[0].as_py()]
        side = table.column("side").to_numpy()
        vec = np.asarray(table.column("vec").combine_chunks().flatten(), dtype=float).reshape(table.num_rows, -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = None
        if leave_one_out:
            codes = np.unique(np.asarray(table.column("id").to_pylist(), dtype=object), return_inverse=True)[1]
            same = codes[left], codes[right]
        i, j, d = _nearest(vec[left], vec[right], same, scale, k, most)
        take = lambda c, at: table.column(c).take(pa.array(at, pa.int64()))
        return pa.table({"dataset_id": take("dataset_id", left[i]), "query": take("id", left[i]), "record": take("id", right[j]), "distance": pa.array(d, pa.float64()), "outcome": take("outcome", right[j]), "confidence": take("confidence", right[j])})

    groups = sum(a * b for _, a, b, _ in cuts)
    local = q.unionByName(r).repartition(min(max(groups, 1), 2000), "dataset_id", "qb", "rb").groupBy("dataset_id", "qb", "rb").applyInArrow(meet, "dataset_id string, query string, record string, distance double, outcome double, confidence double")
    w = Window.partitionBy("dataset_id", "query").orderBy("distance", "record")
    return local.withColumn("place", F.row_number().over(w)).join(sizes.select("dataset_id", "k"), "dataset_id").filter(F.col("place") <= F.col("k")).drop("k")


def estimates(near: DataFrame, config: FeedbackConfig) -> DataFrame:
    """``estimates_by_dataset`` of one dataset: query, neighbors, mean_distance, weighted_outcome, dispersion, conservative_outcome."""
    return estimates_by_dataset(_alone(near), {_ONE: ([], config)}).drop("dataset_id")


def estimates_by_dataset(near: DataFrame, guides: Guides) -> DataFrame:
    """dataset_id, query, neighbors, mean_distance, weighted_outcome, dispersion, conservative_outcome where there are enough neighbours.

    Weights are max(1 - distance, 1e-9)^2 x confidence; the conservative outcome is the weighted mean less the weighted
    population deviation over the root of the number, within -1 and 1.
    """
    least = F.broadcast(near.sparkSession.createDataFrame([(d, config.minimum_neighbors) for d, (_, config) in guides.items()], "dataset_id string, least int"))  # one row a dataset
    w = F.pow(F.greatest(1 - F.col("distance"), F.lit(1e-9)), 2) * F.col("confidence")
    sums = near.groupBy("dataset_id", "query").agg(F.count("*").alias("neighbors"), F.avg("distance").alias("mean_distance"), F.sum(w).alias("w"), F.sum(w * F.col("outcome")).alias("wo"), F.sum(w * F.col("outcome") ** 2).alias("woo"))
    mean = F.col("wo") / F.col("w")
    spread = F.sqrt(F.greatest(F.col("woo") / F.col("w") - mean * mean, F.lit(0.0)))
    cautious = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), mean - spread / F.sqrt(F.col("neighbors").cast("double"))))
    enough = sums.join(least, "dataset_id").filter(F.col("neighbors") >= F.col("least"))
    return enough.select("dataset_id", "query", "neighbors", "mean_distance", mean.alias("weighted_outcome"), spread.alias("dispersion"), cautious.alias("conservative_outcome"))


def guided(candidates: DataFrame, dataset_records: DataFrame, scales: list[float], config: FeedbackConfig) -> DataFrame:
    """``guided_by_dataset`` of one dataset: ``candidates`` (id, fingerprint, vec, ...) with an estimate each, null where there is none."""
    return guided_by_dataset(_alone(candidates), _alone(dataset_records), {_ONE: (scales, config)}).drop("dataset_id")


def guided_by_dataset(candidates: DataFrame, records: DataFrame, guides: Guides) -> DataFrame:
    """``candidates`` (dataset_id, id, fingerprint, vec, ...) with an estimate each from the records of that dataset, null where there is none.

    A candidate that was measured itself, by fingerprint, has that outcome, with one neighbour at distance 0. One whose vec
    is null has no neighbours.
    """
    measured = records.filter("fingerprint is not null").groupBy("dataset_id", "fingerprint").agg(F.max_by("outcome", F.struct("confidence", "id")).alias("measured"))
    est = estimates_by_dataset(neighbours_by_dataset(candidates.filter("vec is not null").select("dataset_id", "id", "vec"), records, guides), guides)
    rows = candidates.join(measured, ["dataset_id", "fingerprint"], "left").join(est.withColumnRenamed("query", "id"), ["dataset_id", "id"], "left")
    own = F.col("measured").isNotNull()
    for c in ("weighted_outcome", "conservative_outcome"):
        rows = rows.withColumn(c, F.when(own, F.col("measured")).otherwise(F.col(c)))
    rows = rows.withColumn("neighbors", F.when(own, F.lit(1)).otherwise(F.col("neighbors")))
    for c in ("mean_distance", "dispersion"):
        rows = rows.withColumn(c, F.when(own, 0.0).otherwise(F.col(c)))
    return rows.withColumn("exact", own).drop("measured")


def guidance_order() -> list[Column]:
    """With guidance first, then by its outcomes, then by structural score, then by fingerprint."""
    return [F.col("conservative_outcome").isNotNull().desc(), F.col("conservative_outcome").desc_nulls_last(), F.col("weighted_outcome").desc_nulls_last(), F.col("structural_score").desc_nulls_last(), F.col("fingerprint").asc()]


def prioritized(candidates: DataFrame, dataset_records: DataFrame, scales: list[float], config: FeedbackConfig) -> DataFrame:
    """Candidates in the order of ``guidance_order``; scores stay as they are."""
    return guided(candidates, dataset_records, scales, config).orderBy(*guidance_order())


def screened(guided_rows: DataFrame, threshold: float) -> DataFrame:
    """All rows, with ``eligible``: the conservative outcome reaches the threshold. Without guidance it never does."""
    return guided_rows.withColumn("eligible", F.coalesce(F.col("conservative_outcome") >= F.lit(threshold), F.lit(False)))


def rank_auc(rows: DataFrame, predicted: str, actual: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row ``auc``, or one for each value of ``keys``: the chance that a positive outcome is predicted above a negative one, ties counting half.

    Predictions are counted by value first, then ranked by a running sum over the distinct values, in range partitions; null
    unless both signs occur. Zero outcomes count as not positive.
    """
    positive = F.col(actual) > 0
    by_value = rows.groupBy(F.struct(*keys, F.col(predicted).alias("__pf_p")).alias("p")).agg(F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(~positive, 1)).alias("neg"))
    won = running_sum(by_value, "p", "neg", "below").select("p.*", "pos", "neg", "below")
    # the running sum goes through all keys, so what came before a key is taken off
    sums = won.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.min("below").alias("before"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("u") - F.col("pos") * F.col("before")) / (F.col("pos") * F.col("neg"))).alias("auc"))


def audit_metrics(predictions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of ``keys``, of records, predicted, coverage, mae, rmse, sign_accuracy, balanced_accuracy, auc.

    ``predictions``: id, actual, predicted (null where not covered). Sign accuracy is over non-zero outcomes; a prediction
    of 0 or less counts as negative in the balanced accuracy.
    """
    p, a = F.col("predicted"), F.col("actual")
    covered = p.isNotNull()
    up, down = covered & (a > 0), covered & (a < 0)
    right = ((p > 0) & (a > 0)) | ((p < 0) & (a < 0))
    rate = lambda hit, of: F.try_divide(F.count(F.when(of & hit, 1)), F.count(F.when(of, 1)))
    m = predictions.groupBy(*keys).agg(
        F.count("*").alias("records"), F.count(p).alias("predicted"), F.avg(F.abs(p - a)).alias("mae"), F.sqrt(F.avg((p - a) ** 2)).alias("rmse"), rate(right, covered & (a != 0)).alias("sign_accuracy"),
        ((rate(p > 0, up) + rate(p <= 0, down)) / 2).alias("balanced_accuracy"),
    )
    auc = rank_auc(predictions.filter(covered), "predicted", "actual", keys)
    both = m.join(auc, list(keys), "left") if keys else m.withColumn("k", F.lit(1)).join(auc.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("coverage", F.try_divide("predicted", "records"))


def leave_one_out(records: DataFrame, scales: list[float], config: FeedbackConfig) -> DataFrame:
    """id, actual, predicted of every record, estimated from the others."""
    return leave_one_out_by_dataset(_alone(records), {_ONE: (scales, config)}).drop("dataset_id")


def leave_one_out_by_dataset(records: DataFrame, guides: Guides) -> DataFrame:
    """dataset_id, id, actual, predicted of every record, estimated from the others of its dataset."""
    est = estimates_by_dataset(neighbours_by_dataset(records.select("dataset_id", "id", "vec"), records, guides, leave_one_out=True), guides)
    return records.select("dataset_id", "id", F.col("outcome").alias("actual")).join(est.select("dataset_id", F.col("query").alias("id"), F.col("weighted_outcome").alias("predicted")), ["dataset_id", "id"], "left")


def holdout(training: FeedbackDataset, evaluation: FeedbackDataset, config: FeedbackConfig, spark: SparkSession) -> DataFrame:
    """id, actual, predicted of the evaluation records from the training records; the two must not overlap."""
    training.checked(), evaluation.checked()
    if (training.context_checksum, training.outcome_label, training.feature_scales) != (evaluation.context_checksum, evaluation.outcome_label, evaluation.feature_scales):
        raise FeedbackError("both datasets must have the same context, label and scales")
    t, e = training.frame(spark), evaluation.frame(spark)
    shared = e.join(t.select("id"), "id", "left_semi").limit(1).unionByName(e.filter("fingerprint is not null").join(t.select("fingerprint"), "fingerprint", "left_semi").select(*e.columns).limit(1))
    if shared.count():
        raise FeedbackError("the evaluation overlaps the training records")
    est = estimates(neighbours(e.select("id", "vec"), t, training.scales, config), config)
    return e.select("id", F.col("outcome").alias("actual")).join(est.select(F.col("query").alias("id"), F.col("weighted_outcome").alias("predicted")), "id", "left").orderBy("id")


def holdout_by_dataset(training: DataFrame, evaluation: DataFrame, guides: Guides) -> DataFrame:
    """dataset_id, id, actual, predicted of the evaluation records from the training records of their dataset.

    Evaluation records whose id or fingerprint is among the training records of their dataset are left out.
    """
    apart = evaluation.join(training.select("dataset_id", "id"), ["dataset_id", "id"], "left_anti")
    apart = apart.join(training.filter("fingerprint is not null").select("dataset_id", "fingerprint"), ["dataset_id", "fingerprint"], "left_anti")
    est = estimates_by_dataset(neighbours_by_dataset(apart.select("dataset_id", "id", "vec"), training, guides), guides)
    return apart.select("dataset_id", "id", F.col("outcome").alias("actual")).join(est.select("dataset_id", F.col("query").alias("id"), F.col("weighted_outcome").alias("predicted")), ["dataset_id", "id"], "left")


@dataclass(frozen=True)
class PolicyConfig:
    strength: float = 0.5
    minimum_support: int = 3
    exploration_floor: float = 0.25
    maximum_multiplier: float = 4.0
    weight_scale: int = 10

    def checked(self) -> PolicyConfig:
        if not (0 <= self.strength <= 1 and self.minimum_support >= 1 and 0 < self.exploration_floor <= 1 <= self.maximum_multiplier and self.weight_scale >= 1):
            raise FeedbackError("invalid operator policy")
        return self


def operator_outcomes(records: DataFrame) -> DataFrame:
    """operator, support, centred: confidence- and count-weighted mean outcome of records with it, less the overall mean.

    ``records``: features (map), outcome, confidence.
    """
    used = records.select(F.explode("features").alias("feature", "n"), "outcome", "confidence").filter((F.col("n") > 0) & F.col("feature").rlike("^operator_.*_count$"))
    overall = records.agg((F.sum(F.col("outcome") * F.col("confidence")) / F.sum("confidence")).alias("overall"))
    w = F.col("confidence") * F.col("n")
    per = used.groupBy(F.regexp_extract("feature", "^operator_(.*)_count$", 1).alias("operator")).agg(F.count("*").alias("support"), (F.sum(F.col("outcome") * w) / F.sum(w)).alias("m"))
    return per.withColumn("k", F.lit(1)).join(overall.withColumn("k", F.lit(1)), "k").select("operator", "support", (F.col("m") - F.col("overall")).alias("centred"))


def operator_weights(records: DataFrame, catalog: Catalog, config: PolicyConfig | None = None) -> DataFrame:
    """dataset_id, operator, weight: ``reweighted`` for the records (features, outcome, confidence) of every dataset at once.

    Datasets without a count of any operator of the catalog that is drawn have no rows.
    """
    config = (config or PolicyConfig()).checked()
    drawn = {o.name: o.weight for o in catalog.operators}
    base = F.element_at(F.create_map(*(F.lit(v) for pair in drawn.items() for v in pair)), F.col("operator"))
    features = records.select("dataset_id", "outcome", "confidence", F.explode("features").alias("feature", "n")).withColumn("operator", F.regexp_extract("feature", "^operator_(.*)_count$", 1))
    known = features.filter(F.col("operator").isin(*(o for o, w in drawn.items() if w)))
    overall = records.groupBy("dataset_id").agg((F.sum(F.col("outcome") * F.col("confidence")) / F.sum("confidence")).alias("overall"))
    w = F.col("confidence") * F.col("n")
    per = known.filter("n > 0").groupBy("dataset_id", "operator").agg(F.count("*").alias("support"), (F.sum(F.col("outcome") * w) / F.sum(w)).alias("m"))
    centred = per.filter(F.col("support") >= config.minimum_support).join(overall, "dataset_id").select("dataset_id", "operator", (F.col("m") - F.col("overall")).alias("centred"))
    most = centred.groupBy("dataset_id").agg(F.max(F.abs("centred")).alias("most"))
    every = known.select("dataset_id").distinct().withColumn("operator", F.explode(F.array(*map(F.lit, drawn))))
    rows = every.join(centred, ["dataset_id", "operator"], "left").join(most, "dataset_id", "left")
    share = F.when(F.col("most") > 0, F.coalesce("centred", F.lit(0.0)) / F.col("most")).otherwise(0.0)
    multiplier = F.least(F.greatest(1 + F.lit(config.strength) * share, F.lit(config.exploration_floor)), F.lit(config.maximum_multiplier))
    weight = F.least(F.greatest(F.floor(base * config.weight_scale * multiplier + F.lit(0.5)), F.lit(1)), F.lit(65535))
    return rows.select("dataset_id", "operator", F.when(base == 0, 0).otherwise(weight).cast("int").alias("weight"))


def reweighted(catalog: Catalog, dataset: FeedbackDataset, config: PolicyConfig | None = None) -> tuple[Catalog, dict[str, int]]:
    """The catalog with generation weights moved by measured outcomes, and those weights."""
    config = (config or PolicyConfig()).checked()
    rows = dataset.checked().records
    overall = sum(r.outcome * r.confidence for r in rows) / sum(r.confidence for r in rows)
    centred: dict[str, float] = {}
    seen = False
    for o in catalog.operators:
        name = f"operator_{o.name}_count"
        if not o.weight or name not in dataset.feature_scales:
            continue
        seen = True
        used = [(r, r.features[name]) for r in rows if r.features.get(name, 0) > 0]
        if len(used) >= config.minimum_support:
            centred[o.name] = sum(r.outcome * r.confidence * n for r, n in used) / sum(r.confidence * n for r, n in used) - overall
    if not seen:
        raise FeedbackError("the dataset has no operator counts")
    most = max(map(abs, centred.values()), default=0.0)
    weights = {}
    for o in catalog.operators:
        share = centred.get(o.name, 0.0) / most if most else 0.0
        multiplier = min(max(1 + config.strength * share, config.exploration_floor), config.maximum_multiplier)
        weights[o.name] = 0 if not o.weight else int(min(max(math.floor(o.weight * config.weight_scale * multiplier + 0.5), 1), 65535))
    out = dataclasses.replace(catalog, operators=tuple(dataclasses.replace(o, weight=weights[o.name]) for o in catalog.operators))
    return out.validated(), weights

