"""Guidance of every candidate by every dataset at once, without moving candidates once a dataset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.plans.lineage import local_uri, new_table_path
from panelforge.plans.workers import ship
from panelforge.search.feedback import Guides

#: Candidates met at once, records read at once, entries of a table of partial sums and of a block of sums.
SLICE, BLOCK, ENTRIES, AT_ONCE = 2**15, 2**16, 2**24, 2**17
_OUT = "dataset int, candidate_id long, ord long, exact boolean, neighbors int, mean_distance double, weighted_outcome double, dispersion double, conservative_outcome double"


def _alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each of the different rows of x, and for every row which of them it equals."""
    bits = (x + 0.0).view(np.uint64)
    # whole numbers have their bits above, where a product would lose them
    h = ((bits ^ (bits >> np.uint64(32))) * (np.random.default_rng(7).integers(1, 2**63, x.shape[1], dtype=np.uint64) | np.uint64(1))).sum(axis=1)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(x[first][inverse], x):  # two rows share a hash
        _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes from 0 of the pairs of two codes."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


class Nearest:
    """The k nearest records of each row of x within ``most``, of records that come in blocks; ties by the records' ranks.

    Distance is the mean of min(|difference| / scale, 1). Features are put into groups of which few combinations occur;
    of each combination the sums over its group are kept, in whole numbers rounded down, so that a pair costs one addition
    a group. What these sums can't rule out is measured exactly.
    """

    def __init__(self, x: np.ndarray, scale: np.ndarray, k: int, most: float):
        self.x, self.scale, self.k, self.most, self.unit = x, scale, k, most, 65_535 // len(scale)
        self.limit = np.full(len(x), most)
        self.row, self.distance, self.rank, self.outcome, self.confidence = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.centre = np.median(x, axis=0)
        self.values, codes = zip(*(np.unique(c, return_inverse=True) for c in x.T))
        some = np.random.default_rng(7).permutation(len(x))[:2048]
        few, groups = max(16, len(some) // 16), []
        for f in sorted(range(len(scale)), key=lambda f: len(self.values[f])):  # by a sample of the rows; a bad choice costs time alone
            tried = [(int((both := _merged(g[1], codes[f][some])).max()), i, both) for i, g in enumerate(groups)]
            n, i, both = min(tried, key=lambda t: t[:2], default=(few, 0, None))
            if n < few:
                groups[i] = groups[i][0] + [f], both
            else:
                groups.append(([f], codes[f][some]))
        self.groups = []
        for features, _ in groups:
            code = codes[features[0]]
            for f in features[1:]:
                code = _merged(code, codes[f])
            first = np.unique(code, return_index=True)[1]
            self.groups.append((features, [codes[f][first] for f in features], code))
        self.width = max(64, ENTRIES // (sum(map(len, self.values)) + sum(len(own[0]) for _, own, _ in self.groups)))

    def meet(self, y: np.ndarray, rank: np.ndarray, outcome: np.ndarray, confidence: np.ndarray) -> None:
        near = np.argsort(np.minimum(np.abs(y - self.centre) / self.scale, 1).sum(axis=1), kind="stable")
        for at in range(0, len(y), self.width):
            part = near[at : at + self.width]
            i, j = self._possible(np.ascontiguousarray(y[part].T))
            j = part[j]
            d = np.zeros(len(i))
            for f, s in enumerate(self.scale):
                d += np.minimum(np.abs(y[j, f] - self.x[i, f]) / s, 1.0)
            d /= len(self.scale)
            ok = d <= self.limit[i]
            i, j, d = i[ok], j[ok], d[ok]
            row, distance, ranks = np.concatenate([self.row, i]), np.concatenate([self.distance, d]), np.concatenate([self.rank, rank[j]])
            order = np.lexsort((ranks, distance, row))
            row = row[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
            order, self.row = order[keep], row[keep]
            self.distance, self.rank = distance[order], ranks[order]
            self.outcome, self.confidence = np.concatenate([self.outcome, outcome[j]])[order], np.concatenate([self.confidence, confidence[j]])[order]
            last = np.flatnonzero(np.arange(len(self.row)) - np.searchsorted(self.row, self.row) == self.k - 1)
            self.limit[self.row[last]] = self.distance[last]

    def _possible(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and columns of y that may be among the nearest."""
        m = -(-y.shape[1] // 8) * 8
        tables = []
        single = []
        for f, s in enumerate(self.scale):
            t = np.full((len(self.values[f]), m), 65_535, np.uint16)
            t[:, : y.shape[1]] = np.minimum(np.abs(self.values[f][:, None] - y[f]) / s, 1.0) * self.unit
            t[:, y.shape[1] :] = self.unit
            single.append(t)
        for features, own, _ in self.groups:
            t = single[features[0]][own[0]]
            for f, c in zip(features[1:], own[1:]):
                t += single[f][c]
            tables.append(t)
        n, k, step = len(self.x), self.k, max(1, AT_ONCE // m)
        ahead = min(y.shape[1], max(256, 4 * k))
        rows, columns = [], []
        total, other = np.empty((step, m), np.uint16), np.empty((step, m), np.uint16)
        for at in range(0, n, step):
            to = min(n, at + step)
            sums, more = total[: to - at], other[: to - at]
            np.take(tables[0], self.groups[0][2][at:to], axis=0, out=sums, mode="clip")
            for t, (_, _, code) in zip(tables[1:], self.groups[1:]):
                np.take(t, code[at:to], axis=0, out=more, mode="clip")
                sums += more
            # a sum is at most one a feature below what it stands for; 2 more for the rounding of products
            bound = np.floor(self.limit[at:to] * (self.unit * len(self.scale))) + 2
            if k <= ahead:
                bound = np.minimum(bound, np.partition(sums[:, :ahead], k - 1, axis=1)[:, k - 1].astype(float) + len(self.scale) + 2)
            mask = sums <= np.minimum(bound, 65_535).astype(np.uint16)[:, None]
            words = np.flatnonzero(mask.view(np.uint64).reshape(-1))
            w, b = np.nonzero(mask.reshape(-1, 8)[words])
            flat = words[w] * 8 + b
            i, j = flat // m + at, flat % m
            real = j < y.shape[1]
            rows.append(i[real])
            columns.append(j[real])
        return np.concatenate(rows), np.concatenate(columns)

    def estimates(self, least: int) -> tuple[np.ndarray, ...]:
        """Of each row: the number of its neighbours (0 if they are too few), mean distance, weighted outcome, dispersion and conservative outcome."""
        total = lambda v: np.bincount(self.row, v, len(self.x))
        n = np.bincount(self.row, minlength=len(self.x))
        n[n < least] = 0
        w = np.maximum(1 - self.distance, 1e-9) ** 2 * self.confidence
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = total(w)
            mean = total(w * self.outcome) / weight
            spread = np.sqrt(np.maximum(total(w * self.outcome**2) / weight - mean * mean, 0.0))
            return n, total(self.distance) / n, mean, spread, np.clip(mean - spread / np.sqrt(n), -1.0, 1.0)


def _batches(uri: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table in the order of its files."""
    system, path = fs.FileSystem.from_uri(uri)
    for f in sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")):
        with system.open_input_file(f) as source:
            yield from parquet.ParquetFile(source).iter_batches(rows)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), width)


def _guided(slice_: pa.Table, features: str, measured: str, at: list[list[int]], guides: list[tuple[list[float], int, int, float]], most_rows: int) -> Iterator[pa.RecordBatch]:
    n = slice_.num_rows
    vec = slice_.column("vec").combine_chunks()
    there = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False))
    x = np.zeros((0, 0)) if not len(there) else _matrix(vec, vec.value_lengths()[int(there[0])].as_py()) if len(there) == n else _matrix(vec.take(pa.array(there)), vec.value_lengths()[int(there[0])].as_py())
    exact = np.full((len(at), n), np.nan)
    prints = slice_.column("fingerprint").combine_chunks()
    for b in _batches(measured, most_rows):
        code = b.column("dataset").to_numpy()
        for d in np.unique(code):
            own = np.flatnonzero(code == d)
            found = pc.index_in(prints, value_set=b.column("fingerprint").take(pa.array(own)), skip_nulls=True)
            hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            exact[d, hit] = b.column("measured").to_numpy()[own][found.take(pa.array(hit)).to_numpy()]
    ids, order = slice_.column("candidate_id").combine_chunks(), slice_.column("ord").combine_chunks()
    state: dict[int, tuple[np.ndarray, list[Nearest]]] = {}

    def nearest(d: int) -> tuple[np.ndarray, list[Nearest]]:
        """The rows of dataset d that have all of its features, as which of the different ones, and these in parts of bounded results."""
        scale, k, _, most = guides[d]
        if not len(there) or not scale or min(at[d]) < 0:
            return there[:0], []
        own = np.ascontiguousarray(x[:, at[d]])
        whole = np.isfinite(own).all(axis=1)
        if not whole.any():
            return there[:0], []
        own = own[whole]
        first, same = _alike(own)
        where = np.full(n, -1)
        where[there[whole]] = same
        step = max(1, min(len(first), 2**22 // k))
        return where, [Nearest(own[first[i : i + step]], np.array(scale), k, most) for i in range(0, len(first), step)]

    def rows(d: int) -> pa.RecordBatch:
        where, parts = state.pop(d) if d in state else (there[:0], [])
        columns = [np.concatenate([np.zeros(1), *c]) for c in zip(*(p.estimates(guides[d][2]) for p in parts))] or [np.zeros(1)] * 5
        values = [c[(where if parts else np.full(n, -1)) + 1] for c in columns]  # 0: without neighbours
        own = ~np.isnan(exact[d])
        missing = ~own & (values[0] == 0)
        neighbors, mean, outcome, spread, cautious = values[0], *(np.where(own, e, v) for e, v in zip((0.0, exact[d], 0.0, exact[d]), values[1:]))
        out = [pa.array(np.full(n, d, np.int32)), ids, order, pa.array(own), pa.array(np.where(own, 1, neighbors).astype(np.int32), mask=missing), *(pa.array(v, mask=missing) for v in (mean, outcome, spread, cautious))]
        return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _OUT.split(", ")])

    done = 0
    for b in _batches(features, most_rows):  # by dataset, so each is done when the next begins
        code = b.column("dataset").to_numpy()
        for d in np.unique(code):
            while done < d:
                yield rows(done)
                done += 1
            own = np.flatnonzero(code == d)
            if d not in state:
                state[d] = nearest(d)
            if state[d][1]:
                y = _matrix(b.column("vec").slice(int(own[0]), len(own)), len(guides[d][0]))
                rank, outcome, confidence = (b.column(c).to_numpy()[own] for c in ("rank", "outcome", "confidence"))
                for p in state[d][1]:
                    p.meet(y, rank, outcome, confidence)
    for d in range(done, len(at)):
        yield rows(d)


def guided_by_all(candidates: DataFrame, features: list[str], records: DataFrame, guides: Guides, keys: dict[str, list[str]], slice_: int = SLICE, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """The rows of ``_OUT``, a table of all ``candidates`` with all datasets; and the names of the datasets by their number.

    ``candidates``: candidate_id, fingerprint, ord, vec with the values of ``features``, null where there are none;
    ``records``: dataset_id, id, fingerprint, vec, outcome, confidence. Estimates as in feedback.guided_by_dataset. The
    records are written once, and a task meets its candidates with all of them, block by block, so that neither is copied
    for the other.
    """
    spark = candidates.sparkSession
    ship(spark)
    names = sorted(guides)
    number = F.broadcast(spark.createDataFrame([(d, i) for i, d in enumerate(names)], "dataset_id string, dataset int"))  # one row a dataset
    rows = records.join(number, "dataset_id").withColumn("id", F.col("id").cast("string"))
    paths = [new_table_path(spark, n) for n in ("records", "measured", "guided")]
    sized = rows.select("dataset", "id", "vec", "outcome", "confidence")
    sized.repartitionByRange(max(1, -(-sized.count() // block)), "dataset", "id").sortWithinPartitions("dataset", "id").withColumn("rank", F.monotonically_increasing_id()).drop("id").write.parquet(paths[0])
    rows.filter("fingerprint is not null").groupBy("dataset", "fingerprint").agg(F.max_by("outcome", F.struct("confidence", "id")).alias("measured")).write.parquet(paths[1])
    at = [[features.index(k) if k in features else -1 for k in keys[d]] for d in names]
    own = [([float(s) for s in guides[d][0]], (c := guides[d][1].checked()).neighbors, c.minimum_neighbors, c.maximum_distance) for d in names]
    uris = [local_uri(spark, p) for p in paths[:2]]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, slice_):
                held.append(b.slice(i, slice_))
                n += held[-1].num_rows
                if n >= slice_:
                    yield from _guided(pa.Table.from_batches(held), *uris, at, own, block)
                    held, n = [], 0
        if n:
            yield from _guided(pa.Table.from_batches(held), *uris, at, own, block)

    candidates.select("candidate_id", "ord", "fingerprint", "vec").mapInArrow(meet, _OUT).write.parquet(paths[2])
    return spark.read.schema(_OUT).parquet(paths[2]), names
