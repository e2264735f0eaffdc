"""Problem 3: the k nearest records of every record, by randomly rotated one-bit codes and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.plans.current import latest
from panelforge.plans.lineage import cut
from panelforge.plans.workers import ship

#: Dimensions of the rotated space, one bit each.
BITS = 512

#: Records that a block holds, and that a cell is to hold; a cell of more is several blocks.
BLOCK = 12_288

#: Most cells of one part. Their centres are a sample of so many records at most; every record is in a cell.
MOST_CELLS = 4096

#: Queries that one task holds against one block.
QUERIES = 50_000

#: Standard errors of the estimate that a record may lie beyond the k-th nearest and still be reranked.
BOUND = 3.0

#: Error of an estimate besides that of the codes: the finite number of frequencies.
FLOOR = 0.012


def dims_of(features: int, bits: int = BITS) -> int:
    """Dimensions of the rotated space: twice as many frequencies for each feature as fit."""
    return 2 * features * max(1, bits // (2 * features))


class Rotation:
    """Vectors whose inner product is 1 - distance, rotated at random, and their one-bit codes.

    The distance of one feature, min(|x - y| / scale, 1), is 1 minus a triangle in (x - y) / scale. A triangle is the
    mean of cos(w (x - y)) over frequencies w of density (sin(w/2) / (w/2))^2 / 2 pi; so cosines and sines of a few
    frequencies of each feature make a unit vector whose inner products are 1 - distance, nearly. A random rotation
    spreads the error of taking signs evenly: with o' the signs over sqrt(d), the correction scalar <o', o> is near
    sqrt(2 / pi), and <o', q'> = 1 - 2 h / d, h the number of bits that differ, is on average 2 / pi times the arc sine of
    <o, q>. So sin(<o', q'> / (<o', o> <q', q>)) estimates <o, q>, from packed bits and two scalars alone; the standard
    error of its argument is pi sqrt(p (1 - p) / d) where the share p of differing bits is arccos(<o, q>) / pi.
    """

    def __init__(self, features: int, bits: int = BITS, seed: int = 20):
        rng = np.random.default_rng([seed, features])
        each = max(1, bits // (2 * features))
        t = np.linspace(0.0, 400.0, 400_001)
        density = np.sinc(t / np.pi) ** 2
        mass = np.cumsum(density)
        mass /= mass[-1]
        strata = (np.arange(each)[None, :] + rng.random((features, each))) / each
        self.frequency = 2 * np.interp(strata, mass, t)  # features x each
        self.dims = dims_of(features, bits)
        q, r = np.linalg.qr(rng.standard_normal((self.dims, self.dims)))
        self.turn = (q * np.sign(np.diag(r))).astype(np.float32)

    def rotated(self, scaled: np.ndarray) -> np.ndarray:
        """Unit vectors, float32, of records given as features over scale."""
        out = np.empty((len(scaled), self.dims), np.float32)
        for a in range(0, len(scaled), 4096):
            phase = (scaled[a : a + 4096, :, None] * self.frequency[None]).reshape(len(scaled[a : a + 4096]), -1)
            wave = np.concatenate((np.cos(phase), np.sin(phase)), 1).astype(np.float32) / np.float32(np.sqrt(self.dims / 2))
            out[a : a + 4096] = wave @ self.turn
        return out

    def codes(self, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed signs, and the correction scalar <o', o> of each."""
        return np.packbits(rotated > 0, axis=1), (np.abs(rotated).sum(1) / np.sqrt(self.dims)).astype(np.float32)


_ROTATIONS: dict[tuple[int, int], Rotation] = {}


def rotation(features: int, bits: int = BITS) -> Rotation:
    if (features, bits) not in _ROTATIONS:
        _ROTATIONS[features, bits] = Rotation(features, bits)
    return _ROTATIONS[features, bits]


def exact_distance(a: np.ndarray, b: np.ndarray, scales: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(a - b) / scales, 1.0).mean(1)


def scaled_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``exact_distance`` but for rounding, of rows given as features over scale: without divisions, in one buffer."""
    out = np.subtract(a, b)
    np.abs(out, out=out)
    np.minimum(out, 1.0, out=out)
    return out @ np.full(out.shape[1], 1.0 / out.shape[1])


#: What ``scaled_distance`` may differ from the exact distance by.
ROUNDING = 1e-9


def words(codes: list[bytes]) -> np.ndarray:
    """Packed signs as rows of 64-bit words."""
    flat = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    wide = np.zeros((len(codes), -(-flat.shape[1] // 8) * 8), np.uint8)
    wide[:, : flat.shape[1]] = flat
    return wide.view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray, tile: int = 2048) -> np.ndarray:
    """How many bits differ between each row of ``a`` and each of ``b``, in tiles that stay in a processor's cache."""
    out = np.empty((len(a), len(b)), np.uint16)
    columns, rows = np.ascontiguousarray(b.T), np.ascontiguousarray(a.T)[:, :, None]
    apart, ones = np.empty((len(a), tile), np.uint64), np.empty((len(a), tile), np.uint8)
    for at in range(0, len(b), tile):
        n = min(tile, len(b) - at)
        x, c, total = apart[:, :n], ones[:, :n], out[:, at : at + n]
        for w in range(a.shape[1]):
            np.bitwise_xor(rows[w], columns[w, at : at + n], out=x)
            np.bitwise_count(x, out=c)
            if w:
                total += c
            else:
                total[:] = c
    return out


def nearest(queries: tuple, base: tuple, scales: np.ndarray, k: int, dims: int, offset: int | None = None, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base, distance) of the k nearest of each query, ties by base index; ``offset``: query i is base i + offset.

    ``queries`` and ``base``: vectors, words, corrections. ``within``: a distance for each query beyond which nothing is
    wanted; without it, the exact distances of some of the best estimates bound the k-th nearest. Every base record whose
    estimate less its error bound is within that bound is reranked exactly.
    """
    (q, qw, qc), (b, bw, bc) = queries, base
    n, m = len(q), len(b)
    want = min(k, m - (offset is not None))
    none = np.empty(0, np.int64)
    if want < 1 or not n:
        return none, none, none.astype(float)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    smallest, largest = float(bc.min()), float(bc.max())
    qs, bs = q / scales, b / scales
    for a in range(0, n, 32):
        part, own = q[a : a + 32], np.arange(len(q[a : a + 32]))
        bits = differing(qw[a : a + 32], bw)
        if offset is not None:
            bits[own, own + a + offset] = dims + 1
        if within is None:
            # the fewest differing bits in each of some equal slices of the base, and of those the k-th nearest: an upper bound
            slices = max(want, min(m // 8, 8 * want))
            width = m // slices
            if width > 1:
                guess = bits[:, : slices * width].reshape(len(part), slices, width).argmin(2) + np.arange(slices) * width
            else:
                guess = np.tile(np.arange(m), (len(part), 1))
            first = scaled_distance(np.repeat(qs[a : a + 32], guess.shape[1], 0), bs[guess.ravel()]).reshape(guess.shape)
            first[np.take_along_axis(bits, guess, 1) > dims] = np.inf  # itself
            kth = np.partition(first, want - 1, axis=1)[:, want - 1] + ROUNDING
        else:
            kth = within[a : a + 32]
        share = np.arccos(np.clip(1 - kth, -1.0, 1.0)) / np.pi
        # the least argument of the sine, (1 - 2 h / dims) / (c c'), that a record within the bound may be estimated at
        least = np.arcsin(np.clip(1 - kth - FLOOR, -1.0, 1.0)) - BOUND * np.pi * np.sqrt(share * (1 - share) / dims) - 1e-6
        scaled = least * qc[a : a + 32]
        most = np.floor(dims / 2 * (1 - scaled * np.where(scaled > 0, smallest, largest)) + 1e-6).clip(-1, dims)
        i, j = np.nonzero(bits <= most.astype(np.int16)[:, None])
        ok = (1 - bits[i, j] * (2 / dims)) >= scaled[i] * bc[j]
        i, j = i[ok], j[ok]
        for c in range(0, len(i), 400_000):  # exact distances a slice at a time
            x, y = i[c : c + 400_000], j[c : c + 400_000]
            close = scaled_distance(qs[a + x], bs[y]) <= kth[x] + ROUNDING
            x, y = x[close], y[close]
            d = exact_distance(part[x], b[y], scales)
            near = d <= kth[x] + ROUNDING
            found.append((x[near] + a, y[near], d[near]))
    if not found:
        return none, none, none.astype(float)
    x, y, d = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((y, d, x))
    x, y, d = x[order], y[order], d[order]
    keep = np.arange(len(x)) - np.searchsorted(x, x, "left") < want
    return x[keep], y[keep], d[keep]


def _unpacked(table: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = pa.array(rows)
    vec = np.asarray(table.column("vec").take(at).combine_chunks().flatten()).reshape(len(rows), -1)
    return vec, words(table.column("code").take(at).to_pylist()), np.asarray(table.column("correction").take(at))


def _within_block(key, table):  # no hints: Spark would read them as another kind of function
    """Each record with its nearest in its own block, and the distance of the k-th (null where there are fewer)."""
    table = table.combine_chunks().sort_by("item")  # ties go by item, bytewise
    n, k = table.num_rows, table.column("k")[0].as_py()
    own = _unpacked(table, np.arange(n))
    x, y, d = nearest(own, own, np.asarray(table.column("scales")[0].values), k, dims_of(own[0].shape[1]), 0)
    counts = np.bincount(x, minlength=n)
    ends = np.cumsum(counts)
    full = counts == k
    bound = np.where(full, d[np.maximum(ends - 1, 0)] if len(d) else 0.0, 2.0)
    pairs = pa.StructArray.from_arrays([table.column("item").take(pa.array(y)).combine_chunks(), pa.array(d, pa.float64())], ["neighbor", "distance"])
    near = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pairs)
    return table.append_column("bound", pa.array(bound)).append_column("near", near)


def _against_block(key, table):
    """The nearest in a block of queries from elsewhere, none beyond the distance that each has already."""
    table = table.combine_chunks().sort_by("item")
    side = table.column("side").to_numpy()
    left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    none = pa.table({"part": pa.array([], pa.string()), "query": pa.array([], pa.string()), "neighbor": pa.array([], pa.string()), "distance": pa.array([], pa.float64()), "k": pa.array([], pa.int32())})
    if not len(left) or not len(right):
        return none
    k = table.column("k")[0].as_py()
    q, b = _unpacked(table, left), _unpacked(table, right)
    bound = table.column("bound").to_numpy()[left]
    x, y, d = nearest(q, b, np.asarray(table.column("scales")[0].values), k, dims_of(q[0].shape[1]), None, bound)
    ids = table.column("item")
    return pa.table({"part": pa.array([key[0].as_py()] * len(x), pa.string()), "query": ids.take(pa.array(left[x])), "neighbor": ids.take(pa.array(right[y])), "distance": pa.array(d, pa.float64()), "k": pa.array(np.full(len(x), k, np.int32))})


def indexed(classes: DataFrame) -> DataFrame:
    """Adds code and correction to every row: the index. Nothing is sampled or fitted; the rotation is fixed."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            size = batch.schema.get_field_index("vec")
            codes: list = [None] * n
            corrections = np.ones(n, np.float32)
            lengths = np.asarray(pc.list_value_length(batch.column(size)))
            flat, at = np.asarray(batch.column(size).flatten()), np.concatenate(([0], np.cumsum(lengths)))
            scale = np.asarray(batch.column(batch.schema.get_field_index("scales")).flatten())
            for width in np.unique(lengths):
                rows = np.flatnonzero(lengths == width)
                cells = at[rows][:, None] + np.arange(width)
                turn = rotation(int(width))
                packed, c = turn.codes(turn.rotated(flat[cells] / scale[cells]))
                corrections[rows] = c
                for r, p in zip(rows.tolist(), packed):
                    codes[r] = p.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(corrections)], names=[*batch.schema.names, "code", "correction"])

    ship(classes.sparkSession)
    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("correction", T.FloatType())]))


def usable_vectors(records: DataFrame, datasets: DataFrame) -> DataFrame:
    """part (dataset), item (record), vec, scales, k of the usable records: exactly the dataset's keys, all finite.

    The row of a record with the latest recorded_at counts. Records of unknown datasets, and datasets with null, zero or
    negative scales, without keys or with fewer than one neighbour, take no part.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    known = datasets.select(F.col("dataset_id").alias("part"), F.array_sort(F.map_keys("feature_scales")).alias("keys"), "feature_scales", F.col("neighbors").alias("k")).dropDuplicates(["part"])
    known = known.withColumn("scales", F.transform("keys", lambda x: F.try_element_at("feature_scales", x))).drop("feature_scales")
    known = known.filter((F.col("k") >= 1) & (F.size("keys") > 0) & F.forall("scales", lambda s: finite(s) & (s > 0)))
    now = latest(records.select("dataset_id", "record_id", "features", "recorded_at"), ["dataset_id", "record_id"], [F.col("recorded_at").desc_nulls_last()])
    rows = now.select(F.col("dataset_id").alias("part"), F.col("record_id").alias("item"), "features").join(known, "part")
    rows = rows.filter(F.size("features") == F.size("keys")).withColumn("vec", F.transform("keys", lambda x: F.try_element_at("features", x)))
    return rows.filter(F.forall("vec", finite)).select("part", "item", "vec", "scales", "k")


def _far(centres: tuple[np.ndarray, np.ndarray], vec: np.ndarray) -> np.ndarray:
    """Distances of rows to centres, given with their scales."""
    return np.stack([np.minimum(np.abs(vec - c) / centres[1], 1.0).mean(1) for c in centres[0]], 1)


class Cells:
    """The centres of each part's cells, their radii and blocks: what is known on the driver and sent to the tasks.

    A part of more records than a block has about one cell for each block's worth, at most MOST_CELLS; centres are records
    drawn by hash, and every record is in the cell of its nearest centre.
    """

    def __init__(self, index: DataFrame, block: int):
        self.block = block
        sizes = index.groupBy("part").agg(F.least(F.ceil(F.count("*") / F.lit(float(block))), F.lit(MOST_CELLS)).cast("int").alias("cells")).filter("cells > 1")
        drawn = index.select("part", "item", "vec", "scales").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("item"), "item"))).filter(F.col("place") <= MOST_CELLS)
        rows = drawn.join(sizes, "part").filter(F.col("place") <= F.col("cells")).collect()  # one row for a block's worth of records, at most MOST_CELLS a part
        lists: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["part"], r["place"])):
            lists.setdefault(r["part"], []).append((r["vec"], r["scales"]))
        self.centres = {p: (np.array([v for v, _ in x]), np.array(x[0][1])) for p, x in lists.items()}
        #: of each part with cells: radius and records of each
        self.stats: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def placed(self, index: DataFrame) -> DataFrame:
        """``index`` with cell, its distance to the cell's centre (``out``), and ``sub``: which block of the cell."""
        centres = self.centres

        def run(batches):
            for batch in batches:
                parts = batch.column(batch.schema.get_field_index("part")).to_pylist()
                cell, out = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                column = batch.column(batch.schema.get_field_index("vec"))
                for p in set(parts) & set(centres):
                    rows = np.flatnonzero(np.array([x == p for x in parts]))
                    far = _far(centres[p], np.asarray(column.take(pa.array(rows)).flatten()).reshape(len(rows), -1))
                    cell[rows] = far.argmin(1)
                    out[rows] = far.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(out)], names=[*batch.schema.names, "cell", "out"])

        added = [T.StructField("cell", T.IntegerType()), T.StructField("out", T.DoubleType())]
        rows = cut(index.mapInArrow(run, T.StructType([*index.schema.fields, *added])))
        found = rows.filter(F.col("part").isin(*self.centres)).groupBy("part", "cell").agg(F.count("*").alias("n"), F.max("out").alias("radius"))
        for r in found.collect() if self.centres else []:  # as many as there are centres
            radius, sizes = self.stats.setdefault(r["part"], (np.zeros(len(self.centres[r["part"]][0])), np.zeros(len(self.centres[r["part"]][0]), np.int64)))
            radius[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
        several = {f"{p}|{c}": int(n) for p in self.stats for c, n in enumerate(self.blocks(p)) if n > 1}  # only cells of more than a block
        return rows.withColumn("sub", F.pmod(F.xxhash64("item"), _looked_up(several, F.concat_ws("|", "part", "cell"))).cast("int"))

    def blocks(self, part: str) -> np.ndarray:
        """How many blocks each cell of a part has."""
        return -(-self.stats[part][1] // self.block)

    def salts(self) -> Column:
        """Into how many groups the queries of the row's part are split, so that one task meets a bounded number."""
        return _looked_up({p: int(-(-x[1].sum() // QUERIES)) for p, x in self.stats.items() if x[1].sum() > QUERIES}, F.col("part"))

    def asked(self, first: DataFrame, probes: int | None) -> DataFrame:
        """For each record the blocks elsewhere that may hold one as near as those it has: part, cell, sub and the record.

        No record of a cell is nearer to a query than the query's distance to the centre less the radius, nor than half of
        what that distance is above the query's distance to its own centre. ``probes``: only the so many nearest cells.
        """
        centres, stats, size = self.centres, self.stats, self.block

        def run(batches):
            for batch in batches:
                at = {n: i for i, n in enumerate(batch.schema.names)}
                parts = batch.column(at["part"]).to_pylist()
                own, sub, bound, out = (np.asarray(batch.column(at[c])) for c in ("cell", "sub", "bound", "out"))
                for p in set(parts) & set(centres):
                    radius, blocks = stats[p][0], -(-stats[p][1] // size)
                    rows = np.flatnonzero(np.array([x == p for x in parts]))
                    d = _far(centres[p], np.asarray(batch.column(at["vec"]).take(pa.array(rows)).flatten()).reshape(len(rows), -1))
                    least = np.maximum(d - radius, (d - out[rows, None]) / 2)
                    ok = (least <= bound[rows, None] + 1e-9) & (blocks > 0)
                    if probes is not None and probes < d.shape[1]:
                        ok &= d <= np.partition(d, probes - 1, axis=1)[:, probes - 1, None]
                    for s in range(int(blocks.max(initial=0))):
                        i, c = np.nonzero(ok & (blocks > s))
                        other = (c != own[rows[i]]) | (s != sub[rows[i]])
                        i, c = i[other], c[other]
                        if len(i):
                            took = pa.array(rows[i])
                            yield pa.RecordBatch.from_arrays([pa.array([p] * len(i)), pa.array(c.astype(np.int32)), pa.array(np.full(len(i), s, np.int32)), *(batch.column(at[n]).take(took) for n in ("item", "vec", "scales", "k", "code", "correction", "bound"))], names=_MET)

        kinds = dict(first.dtypes)
        return first.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in _MET))


def _looked_up(values: dict[str, int], key: Column) -> Column:
    """The value of a key, 1 where it has none."""
    if not values:
        return F.lit(1)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key), F.lit(1))


_MET = ["part", "cell", "sub", "item", "vec", "scales", "k", "code", "correction", "bound"]


def nearest_records(vectors: DataFrame, block: int = BLOCK, probes: int | None = None) -> DataFrame:
    """part, query, neighbor, distance, place (1..k) of the k nearest items of its part for every row of ``vectors``.

    Itself isn't counted; ties go to the smaller item. Items must be unique within a part. A part with fewer than k + 1
    items gives all there are. An empty table gives no rows.

    Items with equal vectors are one row in the search, so a huge group of copies costs nothing; then each gets the
    nearest of its class's neighbours. Every item is first held against the block of its own cell; the k-th distance it
    finds there decides which other cells can hold anything nearer (an exact bound), and only their blocks are asked. With
    ``probes``, at most so many cells are asked for each item, so work and shuffle grow in proportion to the items, at a
    loss of recall. Blocks hold a bounded number of items and meet a bounded number of queries in a task.
    """
    same = F.struct("part", "vec")
    ship(vectors.sparkSession)
    keyed = cut(vectors.select("part", "item", "vec", "scales", F.col("k").cast("int").alias("k"), F.xxhash64(same).alias("k1"), F.hash(F.lit(3), "part", F.reverse("vec")).alias("k2")))
    classes = keyed.groupBy("part", "k1", "k2").agg(F.min("item").alias("item"), F.first("vec").alias("vec"), F.first("scales").alias("scales"), F.first("k").alias("k"))
    index = cut(indexed(classes))
    best = index.agg(F.max("k")).first()[0]
    if best is None:
        return vectors.select("part", F.col("item").alias("query"), F.col("item").alias("neighbor"), F.lit(0.0).alias("distance"), F.lit(1).alias("place")).limit(0)
    cells = Cells(index, block)
    placed = cells.placed(index)
    total = sum(int(cells.blocks(p).sum()) for p in cells.stats)
    # a fixed number of partitions: these are few bytes but much work, which merging small partitions would serialise
    tasks = min(max(total, 24), 4000)
    shape = T.StructType([*placed.schema.fields, T.StructField("bound", T.DoubleType()), T.StructField("near", T.ArrayType(T.StructType([T.StructField("neighbor", T.StringType()), T.StructField("distance", T.DoubleType())])))])
    first = cut(placed.repartition(tasks, "part", "cell", "sub").groupBy("part", "cell", "sub").applyInArrow(_within_block, shape))
    local = first.select("part", F.col("item").alias("query"), F.explode("near").alias("n"), "k").select("part", "query", "n.neighbor", "n.distance", "k")
    if total > 1:
        split = F.col("part").isin(*cells.centres)
        asked = cells.asked(first.filter(split), probes).withColumns({"side": F.lit(1), "salt": F.pmod(F.xxhash64(F.lit(5), "item"), cells.salts()).cast("int")})
        held = placed.filter(split).withColumns({"bound": F.lit(0.0), "side": F.lit(0), "salt": F.explode(F.sequence(F.lit(0), cells.salts().cast("int") - 1))})
        both = asked.select(*_MET, "side", "salt").unionByName(held.select(*_MET, "side", "salt"))
        local = local.unionByName(both.repartition(tasks, "part", "cell", "sub", "salt").groupBy("part", "cell", "sub", "salt").applyInArrow(_against_block, "part string, query string, neighbor string, distance double, k int"))
    w = Window.partitionBy("part", "query").orderBy("distance", "neighbor")
    merged = local.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= best).filter(F.col("rn") <= F.col("k")).drop("rn", "k")
    return _members(keyed, index, merged, int(best))


def _members(keyed: DataFrame, index: DataFrame, links: DataFrame, best: int) -> DataFrame:
    """From the neighbours of classes to those of their items.

    The k + 1 nearest classes hold the k nearest items, and of a class only its k + 1 smallest items can be among them.
    """
    member = keyed.select("part", "item", "k", "k1", "k2").join(index.select("part", "k1", "k2", F.col("item").alias("class")), ["part", "k1", "k2"]).select("part", "class", "item", "k")
    rank = Window.partitionBy("part", "class").orderBy("item")
    firsts = member.withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= best + 1).filter(F.col("rn") <= F.col("k") + 1).select("part", F.col("class").alias("neighbor"), F.col("item").alias("other"))
    own = index.select("part", F.col("item").alias("query"), F.col("item").alias("neighbor"), F.lit(0.0).alias("distance"))
    near = links.select("part", "query", "neighbor", "distance").unionByName(own).join(firsts, ["part", "neighbor"])
    w = Window.partitionBy("part", "query").orderBy("distance", "other")
    lists = near.join(index.select("part", F.col("item").alias("query"), "k"), ["part", "query"]).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= best + 1).filter(F.col("rn") <= F.col("k") + 1)
    packed = lists.groupBy("part", F.col("query").alias("class")).agg(F.array_sort(F.collect_list(F.struct("distance", F.col("other").alias("neighbor")))).alias("near"))  # at most k + 1 each
    rows = member.join(packed, ["part", "class"])
    others = F.slice(F.filter("near", lambda x: x["neighbor"] != F.col("item")), F.lit(1), F.col("k"))
    return rows.select("part", F.col("item").alias("query"), F.posexplode(others).alias("place", "n")).select("part", "query", "n.neighbor", "n.distance", (F.col("place") + 1).alias("place"))
