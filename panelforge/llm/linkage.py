"""Problem 1: deduplicating new batches against all history, by incremental record linkage."""

from __future__ import annotations

import json
import math
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm._prefixes import key_rows, possible, rarity_counts, verified, with_prefixes
from panelforge.llm.components import components
from panelforge.plans.lineage import cut, names_in, new_table_path, read_bytes, write_bytes

THRESHOLD = 0.6

#: Rows of the first batch that one bucket of an index is to hold, and the bounds of their number.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 50_000, 4, 1024

#: Parts of each bucket, so that no key's rows are written by one task.
SPREAD = 4

#: Parts of the rows of one fingerprint or set, which a batch's rows meet one by one: no key's pairs are made in one task.
PARTS = 8

#: Comparison fields and their levels, best first.
FIELDS = {"fingerprint": ["equal", "different", "missing"], "terms": ["same", "close", "similar", "below", "missing"], "root": ["equal", "different", "missing"]}


def _digits(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^[^:]*:", ""), r"[^0-9a-fA-F]", ""))


def fingerprint_key(c: Column | str) -> Column:
    """64 lower-case hex digits, or null: all up to the first colon is dropped, then all but hex digits."""
    return F.when(F.length(_digits(c)) == 64, _digits(c))


def term_hashes(c: Column | str) -> Column:
    """The hashes of the terms in their order; terms are runs of letters, digits, ``_`` and ``.`` of the lower-cased text."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_.]+"), F.lit(0)), lambda t: F.xxhash64(t))


def shingles_of(terms: str, width: int = 3) -> Column:
    """The distinct hashes of each ``width`` consecutive elements of an array column, sorted.

    The array must be a column of its own: an expression would be evaluated again for every element.
    """
    firsts = F.slice(terms, F.lit(1), F.greatest(F.size(terms) - (width - 1), F.lit(0)))
    return F.sort_array(F.array_distinct(F.transform(firsts, lambda v, i: F.xxhash64(v, *(F.get(terms, i + j) for j in range(1, width))))))


def prepared(df: DataFrame, item: str, fingerprint: str, expression: str) -> DataFrame:
    """id, fp, root, k1, k2, n, tokens; one row per distinct content of an id. Null ids are left out.

    (k1, k2) stand for the set of shingles and are null for an empty set or a null expression; root is the hash of the
    first term.
    """
    e = F.coalesce(F.col(expression), F.lit(""))
    read = df.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("id"), _digits(fingerprint).alias("digits"), term_hashes(e).alias("terms"))
    rows = read.select("id", F.when(F.length("digits") == 64, F.col("digits")).alias("fp"), F.get("terms", F.lit(0)).alias("root"), shingles_of("terms").alias("tokens"))
    some = F.size("tokens") > 0
    rows = rows.select("id", "fp", "root", F.when(some, F.xxhash64("tokens")).alias("k1"), F.when(some, F.xxhash64(F.lit(7), F.reverse("tokens"))).alias("k2"), F.size("tokens").alias("n"), "tokens")
    return rows.dropDuplicates(["id", "fp", "root", "k1", "k2"])


class LinkIndex:
    """Tables of everything accepted so far, in the shared folder, and only ever added to, one version for each batch.

    ``prints`` (fp, id, root, k1) by fingerprint; ``members`` (k1, k2, id, fp, root) and ``sets`` (k1, k2, n, tokens, ...)
    by set of shingles; ``keys`` (token, place, n, ...): the prefixes by which a similar set must be met, by token;
    ``clusters`` (id, rep) by id and ``groups`` (rep, id) by representative: changes of the representative mapping, of
    which the latest of an id counts; ``order``: how rare each token was among the first rows added, which the stored
    prefixes depend on (any fixed order finds the same pairs); ``state``: threshold, buckets, weights and version.

    Every table lies in buckets by the hash of its key. A batch is prepared once and reads only the buckets that its own
    fingerprints, tokens and sets fall into, so small batches read a small part of a large history; no expression of the
    history is read, cut into terms or compared again, and only clusters that a new link touches are changed. Lists of
    frequent tokens are split over salts. The state is written last: what a lost run left behind is never read and is
    overwritten by the next batch. With the ``path`` of an index made before, that index is opened, by any later session.
    """

    _KINDS = {
        "prints": "fp string, id long, root long, k1 long", "members": "k1 long, k2 long, id long, fp string, root long", "sets": "k1 long, k2 long, n int, tokens array<bigint>, salts array<int>, b1 long, b2 long",
        "keys": "k1 long, k2 long, n int, b1 long, b2 long, token long, place int, salt int", "clusters": "id long, rep long", "groups": "rep long, id long",
    }

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = THRESHOLD):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        self.spark, self.threshold = spark, threshold
        self.path = path or new_table_path(spark, "links")
        self.version, self.buckets, self.merged = 0, 0, False
        self.order: np.ndarray | None = None
        self.totals: np.ndarray | None = None
        self.weights: dict[str, dict[str, float]] | None = None
        #: of the last batch, the buckets read of each table
        self.read_buckets: dict[str, list[int]] = {}
        if path is not None:
            self._open()

    # tables
    def _open(self) -> None:
        names = [n for n in names_in(self.spark, f"{self.path}/state") if n.endswith(".json")]
        if not names:
            return  # nothing there yet
        last = json.loads(read_bytes(self.spark, f"{self.path}/state/{names[-1]}"))
        if last["threshold"] != self.threshold:
            raise ValueError(f"the index at {self.path} is for a threshold of {last['threshold']}")
        self.version, self.buckets, self.merged, self.weights = last["version"], last["buckets"], last["merged"], last["weights"]
        counts = lambda name: np.frombuffer(zlib.decompress(read_bytes(self.spark, f"{self.path}/{name}")), np.int64)
        self.order, self.totals = counts("counts/order"), counts(f"counts/totals-{self.version:08d}").copy()

    def _commit(self, counted: bool = False) -> None:
        """The state of the present version, after everything that it speaks of; ``counted``: with the counts."""
        if counted:
            if self.version == 1:
                write_bytes(self.spark, f"{self.path}/counts/order", zlib.compress(self.order.tobytes(), 1))
            write_bytes(self.spark, f"{self.path}/counts/totals-{self.version:08d}", zlib.compress(self.totals.tobytes(), 1))
        state = {"version": self.version, "threshold": self.threshold, "buckets": self.buckets, "weights": self.weights, "merged": self.merged}
        write_bytes(self.spark, f"{self.path}/state/{self.version:08d}.json", json.dumps(state).encode())

    def _bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.lit(11), key), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, df: DataFrame, key: str, spread: str) -> None:
        """Adds rows to a table as part of the present version, a bucket spread over a few tasks."""
        rows = df.withColumn("bucket", F.when(F.col(key).isNotNull(), self._bucket(key)).otherwise(self._bucket(spread)))
        rows.repartition("bucket", F.pmod(F.xxhash64(spread), F.lit(SPREAD))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/v={self.version}")

    def _write_all(self, *tables: tuple[str, DataFrame, str, str]) -> None:
        """Several tables at once: they don't wait for one another."""
        with ThreadPoolExecutor(len(tables)) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(self._write), *t) for t in tables]:
                done.result()

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or those of its buckets; what was written after the present version isn't there."""
        df = self.spark.read.schema(f"{self._KINDS[table]}, v int, bucket int").parquet(f"{self.path}/{table}").filter(F.col("v") <= self.version)
        if buckets is not None:
            self.read_buckets[table] = buckets
            if len(buckets) < self.buckets:
                df = df.filter(F.col("bucket").isin(buckets)) if buckets else df.limit(0)
        return df.drop("bucket")

    def _touched(self, **keys: tuple[DataFrame, str]) -> dict[str, list[int]]:
        """The buckets that the keys of some rows fall into, of several tables: at most the number of buckets of each. All where there are few."""
        if self.buckets <= LEAST_BUCKETS:
            return {name: list(range(self.buckets)) for name in keys}
        parts = [df.filter(F.col(key).isNotNull()).select(F.lit(name).alias("name"), self._bucket(key).alias("b")) for name, (df, key) in keys.items()]
        out: dict[str, list[int]] = {name: [] for name in keys}
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        for r in rows.distinct().collect():
            out[r["name"]].append(r["b"])
        return {k: sorted(v) for k, v in out.items()}

    # adding
    def _taken(self, batch: DataFrame) -> tuple[DataFrame, dict[str, list[int]]]:
        """Stores a prepared batch as a new version. The distinct sets of the batch, with their prefixes, and the buckets of its keys."""
        if not self.version:
            self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(batch.count() / BUCKET_ROWS)))
        touched = self._touched(prints=(batch, "fp"), sets=(batch, "k1"))
        own = batch.filter("k1 is not null").groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        known = None
        if self.version:
            stored = self._read("sets", touched["sets"]).drop("v")
            known = cut(stored.join(own.select("k1", "k2"), ["k1", "k2"]))
            own = own.join(known.select("k1", "k2"), ["k1", "k2"], "left_anti")
        own = cut(own)
        counts = rarity_counts(own, "tokens")
        if self.order is None:
            self.order = counts
        self.totals = counts if self.totals is None else self.totals + counts
        fresh = cut(with_prefixes(own, "tokens", self.order, self.threshold, totals=self.totals))
        self.version += 1
        keys = key_rows(fresh).withColumn("salt", F.pmod("k1", F.col("salts")).cast("int")).drop("salts")
        self._write_all(
            ("prints", batch.select("fp", "id", "root", "k1"), "fp", "id"), ("members", batch.filter("k1 is not null").select("k1", "k2", "id", "fp", "root"), "k1", "id"), ("sets", fresh, "k1", "k2"), ("keys", keys, "token", "k1"),
        )
        self._commit(counted=True)
        return fresh.unionByName(known) if known is not None else fresh, touched

    def add(self, rows: DataFrame, item: str, fingerprint: str, expression: str) -> None:
        """Takes rows in without looking for repeats among them: what is accepted already."""
        self._taken(cut(prepared(rows, item, fingerprint, expression)))

    def link(self, rows: DataFrame, item: str, fingerprint: str, expression: str) -> DataFrame:
        """Adds a batch and holds it against the index and itself: earlier_id < later_id, same_fp, similarity, levels of the comparison fields.

        A row for each two ids, at least one of them of the batch, whose fingerprints are valid and equal or whose
        shingle sets have Jaccard of at least the threshold. An id may come in several batches; it isn't linked to itself,
        and of its contents the best level of each field counts. Late arrivals are linked to larger ids as well. A null
        similarity means below the threshold or no terms.
        """
        batch = cut(prepared(rows, item, fingerprint, expression))
        probe, touched = self._taken(batch)
        a = batch.filter("fp is not null").select(F.col("id").alias("x"), F.col("fp").alias("fa"), F.col("root").alias("ra"), F.col("k1").alias("ka"))
        b = self._read("prints", touched["prints"]).filter("fp is not null").select(F.col("id").alias("y"), F.col("fp").alias("fb"), F.col("root").alias("rb"), F.col("k1").alias("kb"))
        every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
        own = F.pmod(F.xxhash64(F.lit(3), "y"), F.lit(PARTS)).cast("int").alias("part")
        met_by_fp = a.select("*", every).alias("a").join(b.select("*", own).alias("b"), (F.col("fa") == F.col("fb")) & (F.col("a.part") == F.col("b.part")))
        by_fp = met_by_fp.drop("part").withColumn("similarity", F.lit(None).cast("double"))

        # the sets of the batch, new to the index or not, against all sets, each met once
        probe = cut(probe)
        left = key_rows(probe)
        right = self._read("keys", self._touched(keys=(left, "token"))["keys"]).drop("v").alias("b")
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").alias("a")
        other = (F.col("a.k1") != F.col("b.k1")) | (F.col("a.k2") != F.col("b.k2"))
        met = left.join(right, (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt")) & other & possible(self.threshold))
        pairs = cut(met.select(F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2")).dropDuplicates())
        there = self._touched(sets=(pairs, "b1"), members=(pairs.select("b1").unionByName(probe.select(F.col("k1").alias("b1"))), "b1"))
        alike = verified(pairs, self._read("sets", there["sets"]).drop("v"), self.threshold, probe)
        equal = probe.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.lit(1.0).alias("similarity"))
        x = batch.filter("k1 is not null").select(F.col("id").alias("x"), F.col("fp").alias("fa"), F.col("root").alias("ra"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
        y = self._read("members", there["members"]).select(F.col("id").alias("y"), F.col("fp").alias("fb"), F.col("root").alias("rb"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
        wide = alike.unionByName(equal).join(x, ["a1", "a2"]).select("*", every).join(y.select("*", own), ["b1", "b2", "part"]).withColumns({"ka": F.col("a1"), "kb": F.col("b1")})

        found = by_fp.unionByName(wide.select(*by_fp.columns)).filter("x != y")
        s = F.col("similarity")
        levels = {
            "fingerprint": F.when(F.col("fa").isNull() | F.col("fb").isNull(), 2).when(F.col("fa") == F.col("fb"), 0).otherwise(1),
            "terms": F.when(s >= 1, 0).when(s >= (1 + self.threshold) / 2, 1).when(s.isNotNull(), 2).when(F.col("ka").isNull() | F.col("kb").isNull(), 4).otherwise(3),
            "root": F.when(F.col("ra").isNull() | F.col("rb").isNull(), 2).when(F.col("ra") == F.col("rb"), 0).otherwise(1),
        }
        merged = found.groupBy(F.least("x", "y").alias("earlier_id"), F.greatest("x", "y").alias("later_id")).agg(F.max("similarity").alias("similarity"), *(F.min(v).alias(f) for f, v in levels.items()))
        named = [F.element_at(F.array(*map(F.lit, FIELDS[f])), F.col(f) + 1).alias(f) for f in FIELDS]
        return cut(merged.select("earlier_id", "later_id", (F.col("fingerprint") == 0).alias("same_fp"), "similarity", *named))

    def compacted(self, path: str) -> LinkIndex:
        """The same index at another place, as one version: what many small batches have written comes together in fewer files."""
        out = LinkIndex(self.spark, path, self.threshold)
        if out.version or not self.version:
            raise ValueError("an index with rows is made anew at a place without one")
        out.version, out.buckets, out.order, out.totals, out.weights, out.merged = 1, self.buckets, self.order, self.totals, self.weights, self.merged
        tables = [(t, self._read(t).drop("v"), key, spread) for t, key, spread in (("prints", "fp", "id"), ("members", "k1", "id"), ("sets", "k1", "k2"), ("keys", "token", "k1"))]
        if self.merged:
            now = cut(self._latest())
            tables += [("clusters", now, "id", "rep"), ("groups", now.select("rep", "id"), "rep", "id")]
        out._write_all(*tables)
        out._commit(counted=True)
        return out

    # weights
    def scored(self, pairs: DataFrame) -> DataFrame:
        """Adds ``weight``, the sum of the fields' learned weights, and ``certain``: equal fingerprints, or similar by the threshold.

        Weights are log2(m / u): u, the chance of a level among any two records, follows from counts over all records
        and pairs; m, the chance among true matches, is learned by expectation maximisation over the counts of the
        patterns of all linked pairs (at most 45 patterns). They are learned from the first pairs scored and then kept
        with the index.
        """
        if self.weights is None:
            self.weights = self._learn(pairs)
            self._commit()
        weight = F.lit(0.0)
        for field, levels in self.weights.items():
            part = F.lit(0.0)
            for level, w in levels.items():
                part = F.when(F.col(field) == level, F.lit(w)).otherwise(part)
            weight = weight + part
        return pairs.withColumns({"weight": weight, "certain": F.col("same_fp") | F.coalesce(F.col("similarity") >= self.threshold, F.lit(False))})

    def _learn(self, pairs: DataFrame) -> dict[str, dict[str, float]]:
        patterns = [(r["fingerprint"], r["terms"], r["root"], r["c"]) for r in pairs.groupBy(*FIELDS).agg(F.count("*").alias("c")).collect()]  # at most 45
        values = F.array(*(F.struct(F.lit(f).alias("f"), F.col(c).cast("string").alias("x")) for f, c in (("all", "id"), ("fingerprint", "fp"), ("root", "root"), ("terms", "k1"))))
        counted = self._read("prints").select(F.explode(values).alias("e")).filter("e.x is not null").groupBy("e.f", "e.x").agg(F.count("*").alias("c"))
        sums = {r["f"]: r for r in counted.groupBy("f").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("same"), F.sum("c").alias("known")).collect()}  # four rows
        total = sums["all"]["known"] if "all" in sums else 0
        if not patterns or total < 2:
            return {f: dict.fromkeys(levels, 0.0) for f, levels in FIELDS.items()}
        every = total * (total - 1) / 2

        def chances(field: str) -> tuple[float, float]:
            r = sums.get(field)
            known = r["known"] / total if r else 0.0
            return (r["same"] / every if r else 0.0), 1 - known * known

        u: dict[str, dict[str, float]] = {}
        for field in ("fingerprint", "root"):
            same, missing = chances(field)
            u[field] = {"equal": same, "missing": missing, "different": max(0.0, 1 - same - missing)}
        _, missing = chances("terms")
        u["terms"] = {level: sum(c for _, t, _, c in patterns if t == level) / every for level in ("same", "close", "similar")}
        u["terms"]["missing"] = missing
        u["terms"]["below"] = max(0.0, 1 - sum(u["terms"].values()))
        smooth = lambda d: {k: (v + 1e-9) / (sum(d.values()) + 1e-9 * len(d)) for k, v in d.items()}
        u = {f: smooth(d) for f, d in u.items()}
        n = sum(p[3] for p in patterns)
        names = list(FIELDS)
        m = {f: {v: (1.0 + sum(p[3] for p in patterns if p[i] == v)) / (n + len(FIELDS[f])) for v in FIELDS[f]} for i, f in enumerate(names)}
        prior = 0.9
        for _ in range(50):
            share = []
            for p in patterns:
                a = prior * math.prod(m[f][p[i]] for i, f in enumerate(names))
                b = (1 - prior) * math.prod(u[f][p[i]] for i, f in enumerate(names))
                share.append(p[3] * a / (a + b))
            mass = sum(share)
            prior = min(max(mass / n, 1e-6), 1 - 1e-6)
            m = {f: {v: (1e-3 + sum(s for s, p in zip(share, patterns) if p[i] == v)) / (mass + 1e-3 * len(FIELDS[f])) for v in FIELDS[f]} for i, f in enumerate(names)}
        return {f: {v: round(math.log2(m[f][v] / u[f][v]), 6) for v in FIELDS[f]} for f in names}

    # clusters
    def _latest(self, buckets: list[int] | None = None) -> DataFrame:
        """id, rep: the present mapping of ids in clusters of two or more, or of those in some buckets."""
        return self._read("clusters", buckets).groupBy("id").agg(F.max(F.struct("v", "rep")).alias("m")).select("id", F.col("m.rep").alias("rep"))

    def mapping(self) -> DataFrame | None:
        """id, rep of every id that is in a cluster of two or more."""
        return self._latest() if self.merged else None

    def merge(self, pairs: DataFrame) -> DataFrame:
        """Joins the clusters of linked ids and returns the changed part of the mapping (id, rep).

        Ends are first replaced by their present representatives; components are found among those alone. A cluster that
        no pair touches is neither read nor written; of those touched only the members of such as lose their
        representative are. A representative is the smallest id, and never comes back once it has lost that place.
        """
        links = pairs.select(F.col("earlier_id").alias("a"), F.col("later_id").alias("b"))
        if self.merged:
            ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
            now = self._latest(self._touched(clusters=(ends, "id"))["clusters"]).join(ends, "id")
            now = cut(now)
            for end in ("a", "b"):
                links = links.join(now.select(F.col("id").alias(end), F.col("rep").alias(f"r{end}")), end, "left").withColumn(end, F.coalesce(f"r{end}", end)).drop(f"r{end}")
        reps = cut(components(links))
        changed = reps.select(F.col("node").alias("id"), "rep")
        if self.merged:
            lost = reps.filter("node != rep").select(F.col("node").alias("old"), F.col("rep").alias("new"))
            moved = self._read("groups", self._touched(groups=(lost, "old"))["groups"]).join(lost, F.col("rep") == F.col("old")).select("id", F.col("new").alias("rep"))
            changed = changed.join(now, ["id", "rep"], "left_anti").unionByName(moved).dropDuplicates(["id"])
            # a representative that stays one is there already
            changed = changed.join(self._latest(self._touched(clusters=(changed, "id"))["clusters"]), ["id", "rep"], "left_anti")
        changed = cut(changed)
        self._write_all(("clusters", changed.select("id", "rep"), "id", "rep"), ("groups", changed.select("rep", "id"), "rep", "id"))
        if not self.merged:
            self.merged = True
            self._commit()
        return changed


def increments(proposals: DataFrame, parts: int) -> list[DataFrame]:
    """The proposals in order of batch_no, in at most ``parts`` increments of whole batches; null batches are in the last."""
    r = proposals.agg(F.min("batch_no").alias("lo"), F.max("batch_no").alias("hi")).first()
    if r["lo"] is None or parts < 2:
        return [proposals]
    width = max(1, math.ceil((r["hi"] - r["lo"] + 1) / parts))
    made = math.ceil((r["hi"] - r["lo"] + 1) / width)
    place = F.coalesce(F.floor((F.col("batch_no") - r["lo"]) / F.lit(float(width))), F.lit(made - 1))
    return [proposals.filter(place == i) for i in range(made)]


def link_history(history: DataFrame, proposals: DataFrame, parts: int = 2, clusters: bool = True, path: str | None = None) -> tuple[LinkIndex, DataFrame]:
    """The history is indexed, then the proposals are linked and added increment by increment. All pairs found."""
    index = LinkIndex(history.sparkSession, path)
    index.add(history, "entry_id", "entries", "expression")
    out = None
    for batch in increments(proposals, parts):
        pairs = index.link(batch, "proposal_id", "semantic_fingerprint", "expression")
        if clusters:
            index.merge(pairs)
        out = pairs if out is None else out.unionByName(pairs)
    return index, out.dropDuplicates(["earlier_id", "later_id"])


def membership(index: LinkIndex, pairs: DataFrame) -> DataFrame:
    """id, class_id (smallest id of its cluster, its own where it repeats nothing), n_links of every id in the index."""
    ids = index._read("prints").select("id").distinct()
    ends = pairs.select(F.col("earlier_id").alias("id")).unionByName(pairs.select(F.col("later_id").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    now = index.mapping()
    out = ids.join(ends, "id", "left")
    rep = F.col("id")
    if now is not None:
        out = out.join(now, "id", "left")
        rep = F.coalesce("rep", "id")
    return out.select("id", rep.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
