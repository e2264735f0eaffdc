import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import knn, linkage, setjoin
from panelforge.llm.components import components


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("list_rows", [20_000, 3])
def test_set_join_finds_exactly_the_similar_pairs(spark, list_rows):
    rng = random.Random(5)
    base = [[f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 25))] for _ in range(60)]
    rows = []
    for i in range(200):
        s = list(rng.choice(base))
        if rng.random() < 0.6 and s:
            s[rng.randrange(len(s))] = f"t{rng.randrange(60)}"
        rows.append((i, [rng.choice([v, f" {v.upper()} "]) for v in s] + [None]))
    rows += [(900, []), (901, None), (902, [None]), (None, ["t1"]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, v array<string>").select("id", setjoin.value_tokens("v").alias("tokens"))
    got = {(r["item_a"], r["item_b"]): r["similarity"] for r in setjoin.similar_pairs(df, "id", "tokens", 0.7, list_rows).collect()}
    sets = {i: {x.strip().lower() for x in v if x} for i, v in rows if i is not None and v}
    want = {(a, b): jaccard(sets[a], sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.7 - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    links = {r["id"]: r for r in setjoin.class_links(df, "id", "tokens", 0.7).collect()}
    for i in links:
        equal = [j for j in sets if sets[j] == sets[i]]
        assert links[i]["class_id"] == min(equal) and links[i]["n_equal"] == len(equal)
        assert links[i]["n_links"] == sum((min(i, j), max(i, j)) in want for j in sets if j != i and sets[j] != sets[i])


def test_set_join_of_nothing_and_of_many_copies(spark):
    empty = spark.createDataFrame([], "id long, tokens array<bigint>")
    assert setjoin.similar_pairs(empty, "id", "tokens", 0.85).count() == 0
    copies = spark.range(300).select(F.col("id"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("tokens"))
    assert setjoin.class_links(copies, "id", "tokens", 0.85).agg(F.sum("n_links"), F.max("n_equal"), F.max("class_id")).first()[:] == (0, 300, 0)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (None, 3)]
    parent = {x: x for ab in links for x in ab if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["rep"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for ab in links if None not in ab and ab[0] != ab[1] for x in ab}


HISTORY, PROPOSALS = "entry_id long, entries string, expression string", "proposal_id long, batch_no int, semantic_fingerprint string, expression string"


def linkage_data():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["rank", "ts_mean", "close", "volume", "5", "20", "std"]) + f"_{rng.randrange(12)}" for _ in range(rng.randrange(2, 14))) for _ in range(40)]
    prints = ["".join(rng.choice("0123456789abcdef") for _ in range(64)) for _ in range(30)]

    def row():
        t = rng.choice([*texts, None, ""])
        if t and rng.random() < 0.4:
            words = t.split()
            words[rng.randrange(len(words))] = "x"
            t = " ".join(words)
        return rng.choice([*prints, f"sha256:{rng.choice(prints).upper()}", "broken", None]), (t or t)

    history = [(i, *row()) for i in range(60)] + [(3, prints[0], texts[0])]
    proposals = [(1000 + i, 1 + i // 12, *row()) for i in range(60)]
    proposals += [(1005, 4, *proposals[5][2:]), (1061, None, prints[1], texts[1])]
    return history, proposals


def linkage_truth(history, proposals):
    def key(p):
        digits = "".join(c for c in (p or "").split(":", 1)[-1].lower() if c in "0123456789abcdef")
        return digits if len(digits) == 64 else None

    def grams(e):
        t = (e or "").lower().split()
        return set(zip(t, t[1:], t[2:]))

    rows = [(i, key(p), grams(e), False) for i, p, e in history] + [(i, key(p), grams(e), True) for i, _, p, e in proposals]
    return {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and b[3] and ((a[1] and a[1] == b[1]) or (a[2] and b[2] and jaccard(a[2], b[2]) >= 0.6 - 1e-12))}


def test_links_of_increments_with_weights_and_clusters(spark):
    parts = 2
    history, proposals = linkage_data()
    index, pairs = linkage.link_history(spark.createDataFrame(history, HISTORY), spark.createDataFrame(proposals, PROPOSALS), parts)
    want = linkage_truth(history, proposals)
    rows = index.scored(pairs).collect()
    assert {(r["earlier_id"], r["later_id"]) for r in rows} == want
    assert all(r["weight"] is not None for r in rows)
    members = {r["id"]: r for r in linkage.membership(index, pairs).collect()}
    parent = {i: i for i in members}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert {i: m["class_id"] for i, m in members.items()} == {i: find(i) for i in members}


def test_an_index_opened_again_finds_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linkage, "BUCKET_ROWS", 10)
    history, proposals = linkage_data()
    path = str(tmp_path / "index")
    linkage.LinkIndex(spark, path).add(spark.createDataFrame(history, HISTORY), "entry_id", "entries", "expression")
    found, rows, weights = set(), spark.createDataFrame(proposals, PROPOSALS), []
    for batch in linkage.increments(rows, 3):
        index = linkage.LinkIndex(spark, path)  # as a later run would
        pairs = index.link(batch, "proposal_id", "semantic_fingerprint", "expression")
        index.scored(pairs)
        weights.append(index.weights)
        index.merge(pairs)
        found |= {(r["earlier_id"], r["later_id"]) for r in pairs.collect()}
    want = linkage_truth(history, proposals)
    assert found == want and index.version == 4 and weights[0] and weights[0] == weights[-1]
    again = linkage.LinkIndex(spark, path)
    assert (again.version, again.buckets, again.merged) == (4, 7, True) and (again.totals == index.totals).all() and (again.order == index.order).all()
    whole = linkage.LinkIndex(spark)
    for part, item, prints in ((spark.createDataFrame(history, HISTORY), "entry_id", "entries"),):
        whole.add(part, item, prints, "expression")
    whole.merge(whole.link(rows, "proposal_id", "semantic_fingerprint", "expression"))
    assert sorted(map(tuple, again.mapping().collect())) == sorted(map(tuple, whole.mapping().collect()))
    with pytest.raises(ValueError, match="threshold"):
        linkage.LinkIndex(spark, path, 0.7)


def test_a_compacted_index_goes_on_alike(spark, tmp_path):
    history, proposals = linkage_data()
    rows = spark.createDataFrame(proposals, PROPOSALS)
    index = linkage.LinkIndex(spark, str(tmp_path / "a"))
    index.add(spark.createDataFrame(history, HISTORY), "entry_id", "entries", "expression")
    first, second = linkage.increments(rows, 2)
    found = index.link(first, "proposal_id", "semantic_fingerprint", "expression")
    index.scored(found)
    index.merge(found)
    pairs = {(r["earlier_id"], r["later_id"]) for r in found.collect()}
    small = index.compacted(str(tmp_path / "b"))
    assert (small.version, small.weights) == (1, index.weights) and sorted(map(tuple, small.mapping().collect())) == sorted(map(tuple, index.mapping().collect()))
    ends = []
    for i in (index, linkage.LinkIndex(spark, str(tmp_path / "b"))):
        more = i.link(second, "proposal_id", "semantic_fingerprint", "expression")
        i.merge(more)
        ends.append((sorted(map(tuple, more.collect())), sorted(map(tuple, i.mapping().collect()))))
    assert ends[0] == ends[1] and pairs | {r[:2] for r in ends[0][0]} == linkage_truth(history, proposals)
    with pytest.raises(ValueError):
        index.compacted(str(tmp_path / "b"))


def test_many_copies_of_one_fingerprint_and_formula(spark):
    text = "rank(ts_mean(close, 20))"
    history = [(i, "a" * 64, text) for i in range(80)]
    proposals = [(1000 + i, 1, "a" * 64, text if i % 2 else None) for i in range(40)]
    _, pairs = linkage.link_history(spark.createDataFrame(history, HISTORY), spark.createDataFrame(proposals, PROPOSALS), 1, clusters=False)
    got = {(r["earlier_id"], r["later_id"]) for r in pairs.collect()}
    assert got == linkage_truth([(i, p, e.replace("(", " ").replace(")", " ").replace(",", " ")) for i, p, e in history], [(i, b, p, e and e.replace("(", " ").replace(")", " ").replace(",", " ")) for i, b, p, e in proposals]) and len(got) == 80 * 40 + 40 * 39 // 2


def test_a_batch_reads_only_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linkage, "BUCKET_ROWS", 40)
    files = {}
    for times in (1, 4):
        rows = [(i, f"{i:064x}", " ".join(f"w{i}_{j}" for j in range(6))) for i in range(300 * times)]
        path = str(tmp_path / f"index{times}")
        linkage.LinkIndex(spark, path).add(spark.createDataFrame(rows, HISTORY), "entry_id", "entries", "expression")
        index = linkage.LinkIndex(spark, path)
        batch = spark.createDataFrame([(9000, 1, rows[7][1], "x y z"), (9001, 1, None, rows[11][2])], PROPOSALS)
        pairs = index.link(batch, "proposal_id", "semantic_fingerprint", "expression")
        assert sorted((r["earlier_id"], r["later_id"], r["fingerprint"], r["terms"]) for r in pairs.collect()) == [(7, 9000, "equal", "below"), (11, 9001, "missing", "same")]
        assert index.buckets == 8 * times - (times == 4) * 2 and len(index.read_buckets["prints"]) == 1 and len(index.read_buckets["sets"]) <= 2 and len(index.read_buckets["members"]) <= 2
        table = index._read("prints", index.read_buckets["prints"])
        files[times] = table.select("_metadata.file_path").distinct().count(), table.count()
    assert files[4][1] < 3 * files[1][1]  # four times the history, about as many rows


def test_rows_left_by_a_lost_run_are_not_read(spark, tmp_path):
    history, proposals = linkage_data()
    path = str(tmp_path / "index")
    index = linkage.LinkIndex(spark, path)
    index.add(spark.createDataFrame(history, HISTORY), "entry_id", "entries", "expression")
    index.version += 1  # a batch whose state was never written
    index._write("prints", spark.createDataFrame([("f" * 64, 77, 5, 1)], index._KINDS["prints"]), "fp", "id")
    other = linkage.LinkIndex(spark, path)
    assert other.version == 1 and other._read("prints").filter("id = 77").count() == 0
    other.link(spark.createDataFrame(proposals, PROPOSALS), "proposal_id", "semantic_fingerprint", "expression")
    assert other.version == 2 and other._read("prints").filter("id = 77").count() == 0


def test_frequent_tokens_are_split(spark, monkeypatch):
    monkeypatch.setattr(linkage.with_prefixes, "__defaults__", (1, None))  # one row a list
    history, proposals = linkage_data()
    index, pairs = linkage.link_history(spark.createDataFrame(history, HISTORY), spark.createDataFrame(proposals, PROPOSALS), 1, clusters=False)
    assert index._read("keys").agg(F.max("salt")).first()[0] > 0
    assert {(r["earlier_id"], r["later_id"]) for r in pairs.collect()} == linkage_truth(history, proposals)


def test_links_of_empty_tables(spark):
    index, pairs = linkage.link_history(spark.createDataFrame([], HISTORY), spark.createDataFrame([], PROPOSALS))
    assert index.scored(pairs).count() == 0


SETS = "dataset_id string, feature_scales map<string,double>, neighbors int"
RECORDS = "dataset_id string, record_id string, features map<string,double>, recorded_at int"


@pytest.mark.parametrize("block", [40, 10_000])
def test_nearest_records_against_brute_force(spark, block):
    rng = random.Random(4)
    scales = {"d1": {"a": 2.0, "b": 0.5, "c": 16.0}, "d2": {"x": 1.0, "y": 4.0}}
    ks = {"d1": 3, "d2": 5}
    rows = []
    for d, n in (("d1", 150), ("d2", 60)):
        for i in range(n):
            f = {k: rng.randrange(64) / 16 * s for k, s in scales[d].items()}
            if rng.random() < 0.3:
                f = dict.fromkeys(scales[d], 1.0)  # many equal vectors
            rows.append((d, f"{d}-{i:03d}", f, 1))
    rows += [("d1", "bad1", {"a": 1.0, "b": 1.0}, 1), ("d1", "bad2", {"a": 1.0, "b": float("nan"), "c": 1.0}, 1), ("d1", "bad3", None, 1), ("d9", "lost", {"a": 1.0}, 1), rows[0]]
    df = spark.createDataFrame(rows, RECORDS)
    sets = spark.createDataFrame([(d, s, ks[d]) for d, s in scales.items()], SETS)
    got = {}
    for r in knn.nearest_records(knn.usable_vectors(df, sets), block).collect():
        got.setdefault(r["query"], []).append((r["distance"], r["neighbor"]))
    for d in scales:
        items = {i: f for x, i, f, _ in rows if x == d and i.startswith("d")}
        for q, f in items.items():
            near = sorted((float(np.mean([min(abs(f[k] - g[k]) / scales[d][k], 1) for k in sorted(f)])), i) for i, g in items.items() if i != q)[: ks[d]]
            assert [i for _, i in sorted(got[q])] == [i for _, i in near]
    assert "lost" not in got and not any(k.startswith("bad") for k in got)


def test_probing_fewer_cells_keeps_most(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12)) * 4
    x = centres[rng.integers(0, 30, 900)] + rng.normal(size=(900, 12)) * 0.2
    df = spark.createDataFrame([("p", f"{i:04d}", v.tolist(), [3.0] * 12, 6) for i, v in enumerate(x)], "part string, item string, vec array<double>, scales array<double>, k int")
    sets = lambda rows: {(r["query"], r["neighbor"]) for r in rows}
    whole, few = sets(knn.nearest_records(df, 60).collect()), sets(knn.nearest_records(df, 60, probes=3).collect())
    far = np.minimum(np.abs(x[:, None] - x[None]) / 3.0, 1).mean(2)
    np.fill_diagonal(far, 9)
    want = {(f"{i:04d}", f"{j:04d}") for i, row in enumerate(np.argsort(far, axis=1, kind="stable")[:, :6]) for j in row}
    assert whole == want and len(few & want) / len(want) >= 0.9


def test_nearest_records_of_nothing(spark):
    assert knn.nearest_records(knn.usable_vectors(spark.createDataFrame([], RECORDS), spark.createDataFrame([], SETS))).count() == 0
    one = spark.createDataFrame([("d", "r", {"a": 1.0}, 1)], RECORDS)
    assert knn.nearest_records(knn.usable_vectors(one, spark.createDataFrame([("d", {"a": 1.0}, 3)], SETS))).count() == 0


def test_codes_keep_recall_on_clustered_vectors():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(40, 24)) * 6)[rng.integers(0, 40, 1500)] + np.abs(rng.normal(size=(1500, 24)) * 0.3)
    scales = np.full(24, 4.0)
    turn = knn.rotation(24)
    packed, c = turn.codes(turn.rotated(x / scales))
    w = knn.words([p.tobytes() for p in packed])
    assert (knn.differing(w[:5], w[:7]) == [[int((np.unpackbits(packed[i]) != np.unpackbits(packed[j])).sum()) for j in range(7)] for i in range(5)]).all()
    q, b, d = knn.nearest((x[:200], w[:200], c[:200]), (x, w, c), scales, 8, turn.dims, 0)
    hits = 0
    for i in range(200):
        truth = np.minimum(np.abs(x - x[i]) / scales, 1).mean(1)
        truth[i] = 9
        hits += len(set(np.argsort(truth, kind="stable")[:8]) & set(b[q == i]))
    assert hits / 1600 >= 0.99
