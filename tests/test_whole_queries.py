import math

import duckdb
import pytest

from panelforge import queries_core
from panelforge.entrypoints import oracle_sql
from panelforge.expr.descriptor import Descriptor
from panelforge.search import feedback

DATA = "/root/testdata/sf0.001"


def tables(*names):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for n in names:
        con.execute(f"create table {n} as select * from '{DATA}/{n}.parquet'")
    return con


def plain(row):
    return tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", ["feedback_knn", "feedback_loo_audit", "feedback_screen", "feedback_guided", "feedback_features", "elite_round_robin"])
def test_queries_over_whole_tables_agree_with_sql(spark, name):
    con = tables("feedback_datasets", "feedback_records", "candidates")
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    df = queries_core.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    want, got = sorted(map(plain, cur.fetchall()), key=str), sorted((plain(r[c] for c in columns) for r in df.collect()), key=str)
    assert len(want) > 0 and got == want
    if "dataset_id" in columns:
        assert {r[columns.index("dataset_id")] for r in got} == {d for (d,) in con.execute("select dataset_id from feedback_datasets").fetchall()}


def brute(vec, records, scales, config):
    near = sorted((sum(min(abs(a - b) / s, 1) for a, b, s in zip(vec, r["vec"], scales)) / len(scales), r["id"], r["outcome"], r["confidence"]) for r in records)
    near = [x for x in near if x[0] <= config.maximum_distance][: config.neighbors]
    if len(near) < config.minimum_neighbors:
        return None
    w = [max(1 - x[0], 1e-9) ** 2 * x[3] for x in near]
    mean = sum(a * x[2] for a, x in zip(w, near)) / sum(w)
    spread = math.sqrt(sum(a * (x[2] - mean) ** 2 for a, x in zip(w, near)) / sum(w))
    return len(near), mean, max(-1, min(1, mean - spread / math.sqrt(len(near))))


def test_guided_meets_all_candidates_with_all_datasets(spark, tmp_path):
    from pyspark.sql import functions as F

    for n in ("candidates", "feedback_datasets"):
        spark.read.parquet(f"{DATA}/{n}.parquet").write.parquet(str(tmp_path / f"{n}.parquet"))
    # one record has the fingerprint of a candidate
    raw = spark.read.parquet(f"{DATA}/candidates.parquet")
    shared = raw.agg(F.min("semantic_fingerprint")).first()[0]
    records = spark.read.parquet(f"{DATA}/feedback_records.parquet")
    some = queries_core._feedback(spark, DATA)[0].orderBy("id").first()
    records.withColumn("semantic_fingerprint", F.when(F.col("record_id") == some["id"], shared).otherwise(F.col("semantic_fingerprint"))).write.parquet(str(tmp_path / "feedback_records.parquet"))
    latest = {}
    for r in raw.collect():
        key = (r["written_at"] is not None, r["written_at"])
        if r["candidate_id"] not in latest or key > latest[r["candidate_id"]][0]:
            latest[r["candidate_id"]] = key, r
    rows, guides, names = queries_core._feedback(spark, str(tmp_path))
    keys = {r["dataset_id"]: r["keys"] for r in names.collect()}
    by = {d: [r for r in rows.collect() if r["dataset_id"] == d] for d in guides}
    got = {(r["dataset_id"], r["candidate_id"]): r for r in queries_core.feedback_guided(spark, str(tmp_path)).collect()}
    assert got.keys() == {(d, c) for d in guides for c in latest} and len(guides) > 1
    clean = lambda xs: tuple({x.strip().lower() for x in xs or () if x is not None})
    order = {d: [] for d in guides}
    some_guided = 0
    for (d, c), g in got.items():
        r = latest[c][1]
        s, est = r["structural_descriptor"], None
        if s is not None:
            lists = {n: clean(s[n]) for n in ("operator_shingles", "ordered_paths", "fields", "field_families", "groups", "lineage_parents")}
            f = feedback.features(Descriptor(**{**s.asDict(), **lists, "operator_histogram": s["operator_histogram"] or {}, "window_buckets": s["window_buckets"] or {}}), r["root_family"].strip().lower() if r["root_family"] else "", r["nodes"], r["depth"])
            est = brute([f[k] for k in keys[d]], by[d], *guides[d])
        exact = r["semantic_fingerprint"] == shared and d == some["dataset_id"]
        est = (1, some["outcome"], some["outcome"]) if exact else est
        assert g["exact"] == exact and (g["neighbors"] is None) == (est is None)
        some_guided += est is not None and not exact
        if est:
            assert g["neighbors"] == est[0] and g["weighted_outcome"] == pytest.approx(est[1], abs=2e-6) and g["conservative_outcome"] == pytest.approx(est[2], abs=2e-6)
        assert g["eligible"] == (est is not None and est[2] >= 0)
        order[d].append((g["place"], est is None, -round(est[2], 6) if est else 0))
    assert some_guided
    for places in order.values():
        places.sort()
        assert [p for p, _, _ in places] == list(range(len(latest))) and [x[1:] for x in places] == sorted(x[1:] for x in places)


def test_audit_by_key_is_the_audit_of_each(spark):
    rows = spark.createDataFrame([(k, str(i), (i * 7 % 5 - 2) / 3, None if i == 4 else ((i + s) * 3 % 7 - 3) / 4) for s, k in enumerate("ab") for i in range(9)], "dataset_id string, id string, actual double, predicted double")
    got = {r["dataset_id"]: r.asDict() for r in feedback.audit_metrics(rows, ("dataset_id",)).collect()}
    for k in "ab":
        want = feedback.audit_metrics(rows.filter(rows["dataset_id"] == k)).first().asDict()
        assert {c: got[k][c] for c in want} == pytest.approx(want)
