"""Problem 4: a subset of given size that covers the variety of the data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm._candidates import current_candidates, tidy
from panelforge.llm._positions import positions
from panelforge.plans.lineage import cut, new_table_path
from panelforge.plans.workers import ship

#: Dimensions that fields, operators and root family are hashed into, and the weight of each part.
PARTS = {"fields": (128, 1.0), "operators": (48, 1.0), "root": (64, 1.3)}
DIMS = sum(d for d, _ in PARTS.values())

#: Mini-batches of one pass over all rows, and of them the most passes.
BATCHES, PASSES = 8, 12

#: Training ends once a pass moves the centres by less than this share of their length (root mean square over all rows).
SETTLED = 0.02

#: Rounds in which starting centres are drawn, each of as many rows as a request has clusters.
ROUNDS = 3

#: Most clusters of one request.
CLUSTERS = 64

#: Sums are made of whole numbers, this many to 1, so that they are the same in any order of tasks.
UNIT = 1 << 20


def clusters_of(size: int) -> int:
    return max(1, min(CLUSTERS, size))


def _hashed(values: Column, first: int, dims: int, factor: Column) -> Column:
    return F.transform(values, lambda e: F.struct((F.pmod(e["h"], F.lit(dims)) + first).cast("int").alias("slot"), (e["x"] * factor).cast("float").alias("x")))


def described(df: DataFrame) -> DataFrame:
    """candidate_id, family, sig, draw, slots: what each current candidate is like.

    sig is the same for candidates of equal fields, histogram and family (null families are alike); draw is a fixed
    pseudo-random order. Candidates without a descriptor are described by their family alone.
    """
    d = "structural_descriptor"
    clean = lambda v: F.lower(F.regexp_replace(v, r"^\s+|\s+$", ""))
    fields = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(F.col(f"{d}.fields"), F.array().cast("array<string>")), lambda v: v.isNotNull()), clean)))
    counts = F.filter(F.coalesce(F.map_entries(f"{d}.operator_histogram"), F.array().cast("array<struct<key:string,value:int>>")), lambda e: e["value"] > 0)
    operators = F.array_sort(F.transform(counts, lambda e: F.struct(clean(e["key"]).alias("key"), e["value"].alias("value"))))
    rows = current_candidates(df, {"family": tidy("root_family"), "fields": fields, "operators": operators})
    at, slots = 0, []
    for name, value in (
        ("fields", F.transform("fields", lambda v: F.struct(F.xxhash64(F.lit("field"), v).alias("h"), F.lit(1.0).alias("x")))),
        ("operators", F.transform("operators", lambda e: F.struct(F.xxhash64(F.lit("operator"), e["key"]).alias("h"), F.log1p(e["value"].cast("double")).alias("x")))),
        ("root", F.when(F.col("family").isNull(), F.array().cast("array<struct<h:bigint,x:double>>")).otherwise(F.array(F.struct(F.xxhash64(F.lit("root"), "family").alias("h"), F.lit(1.0).alias("x"))))),
    ):
        dims, weight = PARTS[name]
        norm = F.sqrt(F.aggregate(value, F.lit(0.0), lambda a, e: a + e["x"] * e["x"]))
        slots.append(_hashed(value, at, dims, F.lit(weight) / norm))
        at += dims
    sig = F.xxhash64("family", F.col("family").isNull(), "fields", "operators")
    return rows.select("candidate_id", "family", sig.alias("sig"), F.xxhash64(F.lit("draw"), "candidate_id").alias("draw"), F.concat(*slots).alias("slots"))


def _vectors(column: pa.Array) -> np.ndarray:
    """Dense rows of a batch's slots."""
    n = len(column)
    row = np.repeat(np.arange(n), np.diff(np.asarray(column.offsets)))
    flat = column.flatten()
    return np.bincount(row * DIMS + np.asarray(flat.field("slot")), np.asarray(flat.field("x")).astype(float), n * DIMS).reshape(n, DIMS)


def _in_pool(family: pa.Array, wanted: str | None, n: int) -> np.ndarray:
    if wanted is None:
        return np.arange(n)
    return np.flatnonzero(np.asarray(pc.fill_null(pc.equal(family, wanted), False)))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, but for the square of x."""
    return (centres**2).sum(1)[None, :] - 2 * (x @ centres.T)


def shares(sizes: dict[int, int], caps: dict[int, int], total: int, how: str = "sqrt") -> dict[int, float]:
    """What each cluster is due of ``total``: in proportion to the square root of its size (or equal), at most its cap.

    Clusters whose part is above their cap get the cap, and what they leave is shared out among the others in the same
    proportion, until none is above.
    """
    weight = {c: math.sqrt(n) if how == "sqrt" else 1.0 for c, n in sizes.items() if caps[c] > 0}
    out: dict[int, float] = dict.fromkeys(sizes, 0.0)
    while weight:
        rate = (total - sum(out.values())) / sum(weight.values())
        full = [c for c, w in weight.items() if w * rate >= caps[c]]
        if not full:
            return out | {c: w * rate for c, w in weight.items()}
        for c in full:
            out[c] = float(caps[c])
            del weight[c]
    return out


def quotas(sizes: dict[int, int], total: int, how: str = "sqrt", caps: dict[int, int] | None = None) -> dict[int, int]:
    """Slots of each cluster: its share, rounded; the slots add up to min(total, all caps).

    ``caps``: what each can give, its size where not named. Shares are settled before any is rounded, so no quota is 1 or
    more off its share. They are rounded down; the slots left go to the largest remainders, then to the larger clusters.
    """
    caps = {c: min(sizes[c], (caps or sizes)[c]) for c in sizes}
    total = min(total, sum(caps.values()))
    share = shares(sizes, caps, total, how)
    got = {c: min(caps[c], int(share[c] + 1e-9)) for c in sizes}
    open_ = sorted((c for c in got if got[c] < caps[c]), key=lambda c: (got[c] - share[c], -sizes[c], c))
    for c in open_[: total - sum(got.values())]:
        got[c] += 1
    return got


class Clusters:
    """Centres for several requests at once, fitted to all rows of their pools, each description weighted by its rows.

    ``table``: family, slots, n (rows), draw and bucket of each description, in partitions by bucket.
    """

    def __init__(self, table: DataFrame, requests: list[tuple[int, str | None, int]]):
        self.table, self.requests = table, requests
        self.centres = self._seeds()
        self.seen = {r: np.zeros(len(c)) for r, c in self.centres.items()}
        self.passes = 0
        #: of each pass, by how much it moved the centres
        self.moves: list[float] = []

    def _far(self, centres: dict[int, np.ndarray], salt: int) -> dict[int, np.ndarray]:
        """Of each request as many rows as it has clusters, drawn by rows x squared distance to the nearest centre.

        Weighted drawing in one pass: the rows with the largest log(u) / weight, u a hash of the row. Each task keeps the
        first of each request and so does what it sends on; only the drawn rows come to the driver.
        """
        requests = self.requests

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, n = _vectors(batch.column(1)), np.asarray(batch.column(2)).astype(float)
                bits = (np.asarray(batch.column(3)).view(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
                u = ((bits >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                for r, family, size in requests:
                    rows = _in_pool(batch.column(0), family, batch.num_rows)
                    weight = n[rows]
                    if len(rows) and r in centres:
                        apart = (x[rows] ** 2).sum(1) + _distances(x[rows], centres[r]).min(1)
                        weight = np.where(apart > 1e-9, weight * apart, 0.0)
                    rows, weight = rows[weight > 0], weight[weight > 0]
                    if len(rows):
                        key = np.log(u[rows]) / weight
                        best = np.argsort(-key, kind="stable")[: clusters_of(size)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), r, np.int32)), pa.array(key[best]), batch.column(3).take(pa.array(rows[best])), batch.column(1).take(pa.array(rows[best]))], names=["r", "key", "draw", "slots"])

        kind = self.table.schema["slots"].dataType.simpleString()
        drawn = self.table.select("family", "slots", "n", "draw").mapInArrow(run, f"r int, key double, draw long, slots {kind}")
        limit = F.broadcast(drawn.sparkSession.createDataFrame([(r, clusters_of(size)) for r, _, size in requests], "r int, most int"))  # one row a request
        first = drawn.withColumn("place", F.row_number().over(Window.partitionBy("r").orderBy(F.col("key").desc(), "draw"))).filter(F.col("place") <= CLUSTERS).join(limit, "r").filter(F.col("place") <= F.col("most"))
        rows = first.select("r", "place", "slots").toArrow().combine_chunks().sort_by([("r", "ascending"), ("place", "ascending")])  # at most 64 a request
        if not rows.num_rows:
            return {}
        x, r = _vectors(rows.column("slots").combine_chunks()), np.asarray(rows.column("r"))
        return {int(i): x[r == i] for i in np.unique(r)}

    def _seeds(self) -> dict[int, np.ndarray]:
        """k-means||: rows far from those drawn so far are drawn in a few rounds over all rows; then each gets the weight of the rows nearest to it, and k-means++ picks among them."""
        drawn = {r: x[:1] for r, x in self._far({}, 0).items()}
        for i in range(ROUNDS):
            for r, x in self._far(drawn, i + 1).items():
                drawn[r] = np.unique(np.concatenate((drawn[r], x)), axis=0)
        weights = {r: np.zeros(len(x)) for r, x in drawn.items()}
        for r, c, _, s in self._summed(self.table, drawn, means=False):
            weights[r][c] = s
        out = {}
        for r, _, size in self.requests:
            if r not in drawn:
                continue
            x, w, rng = drawn[r], weights[r], np.random.default_rng(r)
            picked = [int(np.argmax(w))]
            near = ((x - x[picked[0]]) ** 2).sum(1)
            while len(picked) < min(clusters_of(size), len(x)) and (near * w).sum() > 1e-12:
                at = np.cumsum(near * w)
                picked.append(min(int(np.searchsorted(at, rng.random() * at[-1], "right")), len(x) - 1))
                near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
            out[r] = x[picked].copy()
        return out

    def _summed(self, table: DataFrame, centres: dict[int, np.ndarray], means: bool = True) -> list[tuple]:
        """(request, cluster, dimension, sum over the rows nearest to the cluster's centre); dimension DIMS has their number.

        Sums are whole numbers added up by Spark: what comes to the driver is at most one number for each of these three,
        whatever the number of tasks.
        """
        requests = self.requests

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {r: np.zeros((len(c), DIMS + 1), np.int64) for r, c in centres.items()}
            for batch in batches:
                x, n = _vectors(batch.column(1)), np.asarray(batch.column(2)).astype(np.int64)
                whole = np.concatenate((np.rint(x * UNIT).astype(np.int64) if means else np.zeros((len(x), DIMS), np.int64), np.ones((len(x), 1), np.int64)), 1) * n[:, None]
                for r, family, _ in requests:
                    if r in centres and len(rows := _in_pool(batch.column(0), family, batch.num_rows)):
                        near = _distances(x[rows], centres[r]).argmin(1)
                        order = np.argsort(near, kind="stable")
                        owner, first = np.unique(near[order], return_index=True)
                        sums[r][owner] += np.add.reduceat(whole[rows[order]], first, axis=0)
            for r, s in sums.items():
                c, d = np.nonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), r, np.int32)), pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(s[c, d])], names=["r", "c", "d", "s"])

        made = table.select("family", "slots", "n").mapInArrow(run, "r int, c int, d int, s long").groupBy("r", "c", "d").agg(F.sum("s").alias("s")).toArrow()
        return list(zip(*(made.column(i).to_pylist() for i in range(4))))

    def step(self, bucket: int) -> None:
        """Moves each centre towards the mean of the mini-batch's rows that are nearest to it, at the rate n / all seen."""
        sums = {r: np.zeros((len(c), DIMS + 1)) for r, c in self.centres.items()}
        for r, c, d, s in self._summed(self.table.filter(F.col("bucket") == bucket), self.centres):
            sums[r][c, d] = s if d == DIMS else s / UNIT
        for r, s in sums.items():
            n = s[:, DIMS]
            self.seen[r] += n
            some = n > 0
            self.centres[r][some] += (s[some, :DIMS] - n[some, None] * self.centres[r][some]) / self.seen[r][some, None]

    def fit(self, passes: int = PASSES, settled: float = SETTLED) -> Clusters:
        """Passes over all rows until one moves the centres by less than ``settled``, or ``passes`` are made."""
        while self.centres and self.passes < passes:
            before = {r: c.copy() for r, c in self.centres.items()}
            for bucket in range(BATCHES):
                self.step(bucket)
            self.passes += 1
            moved = sum((self.seen[r] * ((c - before[r]) ** 2).sum(1)).sum() for r, c in self.centres.items())
            length = sum((self.seen[r] * (c**2).sum(1)).sum() for r, c in self.centres.items())
            self.moves.append(math.sqrt(moved / length) if length else 0.0)
            if self.moves[-1] < settled:
                break
        return self

    def assigned(self, rows: DataFrame, *more: str) -> DataFrame:
        """request_id, cluster and the named columns of every row (family, slots, ...) of every pool it is in."""
        centres, requests = self.centres, self.requests

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _vectors(batch.column(1))
                for r, family, _ in requests:
                    if r in centres and len(own := _in_pool(batch.column(0), family, batch.num_rows)):
                        near = _distances(x[own], centres[r]).argmin(1).astype(np.int32)
                        at = pa.array(own)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r, np.int32)), pa.array(near), *(batch.column(2 + i).take(at) for i in range(len(more)))], names=["request_id", "cluster", *more])

        kinds = dict(rows.dtypes)
        return rows.select("family", "slots", *more).mapInArrow(run, "request_id int, cluster int" + "".join(f", {c} {kinds[c]}" for c in more))


class Subsets:
    """The clusters, quotas and choices of several requests over one table of candidates."""

    def __init__(self, candidates: DataFrame, requests: DataFrame, how: str = "sqrt", passes: int = PASSES, settled: float = SETTLED):
        self.spark, self.how = candidates.sparkSession, how
        self.asked = [(r["request_id"], r["family"], r["subset_size"]) for r in requests.select("request_id", tidy("root_family").alias("family"), "subset_size").filter("request_id is not null and subset_size > 0").dropDuplicates(["request_id"]).orderBy("request_id").collect()]  # a table of a few rows
        ship(self.spark)
        self.rows = cut(described(candidates))
        alike = self.rows.groupBy("sig").agg(F.min(F.struct("draw", "candidate_id")).alias("one"), F.first("family").alias("family"), F.first("slots").alias("slots"), F.count("*").alias("n"))
        one = alike.select(F.col("one.candidate_id").alias("candidate_id"), F.col("one.draw").alias("draw"), "family", "slots", "n", F.pmod("one.draw", F.lit(BATCHES)).alias("bucket"))
        self.pool = _written(one, new_table_path(self.spark, "pool"), "bucket")
        self.model = Clusters(self.pool, self.asked).fit(passes, settled)
        #: of each request and cluster: rows, different descriptions
        self.sizes: dict[int, dict[int, tuple[int, int]]] = {}
        counted = self.model.assigned(self.pool, "n").groupBy("request_id", "cluster").agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"))
        for r in counted.collect():  # at most 64 a request
            self.sizes.setdefault(r["request_id"], {})[r["cluster"]] = (r["rows"], r["kinds"])

    def quotas(self) -> dict[int, dict[int, int]]:
        """Slots of each request's clusters, by the square root of their rows; a cluster can give its different descriptions."""
        part = lambda r, i: {c: v[i] for c, v in self.sizes[r].items()}
        return {r: quotas(part(r, 0), size, self.how, part(r, 1)) for r, _, size in self.asked if r in self.sizes}

    def chosen(self) -> DataFrame:
        """request_id, candidate_id: see ``diverse_subsets``."""
        slots = [(r, c, q) for r, own in self.quotas().items() for c, q in own.items() if q]
        if not slots:
            return self.spark.createDataFrame([], "request_id int, candidate_id long")
        quota = self.spark.createDataFrame(slots, "request_id int, cluster int, quota int")  # at most 64 a request
        wanted = self.model.assigned(self.pool, "candidate_id", "draw").join(F.broadcast(quota), ["request_id", "cluster"])
        placed = positions(wanted, ["request_id", "cluster"], [F.col("draw").asc(), F.col("candidate_id").asc()], "place", keep=max(s[2] for s in slots))
        out = placed.filter(F.col("place") <= F.col("quota")).select("request_id", "candidate_id")
        kinds = {r: sum(k for _, k in own.values()) for r, own in self.sizes.items()}
        missing = [(r, f, size - kinds.get(r, 0)) for r, f, size in self.asked if size > kinds.get(r, 0)]
        return out.unionByName(_copies(self.rows, missing)) if missing else out

    def assignments(self) -> DataFrame:
        """request_id, candidate_id, cluster of every candidate of every pool it is in."""
        return self.model.assigned(self.rows, "candidate_id").select("request_id", "candidate_id", "cluster")


def diverse_subsets(candidates: DataFrame, requests: DataFrame, how: str = "sqrt") -> DataFrame:
    """request_id, candidate_id: for each request exactly subset_size distinct candidates of its pool, or all there are.

    Descriptions are hashed vectors, clustered by mini-batch k-means over all rows until the centres have settled; a
    description weighs as many rows as it has. Clusters get square-root (or equal) quotas by their rows, unused slots are
    dealt out again; within its quota a cluster gives those first in a fixed random order. Of candidates of one
    description one is drawn; its copies come in only where a pool has fewer different descriptions than the request
    asks for, one more of each description at a time. Null and non-positive sizes give no rows; ``requests`` is a small
    table, one row per request_id.
    """
    return Subsets(candidates, requests, how).chosen()


def _written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder; the schema is given, as an empty table has no file to read it from."""
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _copies(rows: DataFrame, missing: list[tuple[int, str | None, int]]) -> DataFrame:
    """For requests with too few different descriptions: further copies, the second of each description first."""
    short = rows.sparkSession.createDataFrame(missing, "request_id int, wanted string, lacking int")  # no more than the requests
    most = max(m[2] for m in missing)
    numbered = positions(rows.select("candidate_id", "family", "sig", "draw"), ["sig"], [F.col("draw").asc(), F.col("candidate_id").asc()], "copy", keep=most + 1)
    pooled = numbered.filter("copy > 1").join(F.broadcast(short), F.col("wanted").isNull() | (F.col("wanted") == F.col("family")))
    placed = positions(pooled, ["request_id"], [F.col("copy").asc(), F.col("draw").asc(), F.col("candidate_id").asc()], "place", keep=most)
    return placed.filter(F.col("place") <= F.col("lacking")).select("request_id", "candidate_id")
