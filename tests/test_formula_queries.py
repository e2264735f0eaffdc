import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge import oracle_search, queries_search
from panelforge.expr.analysis import analyze
from panelforge.expr.descriptor import describe, distance
from panelforge.expr.parser import parse
from panelforge.search import artifacts, engine, scoring, selection

DATA = "/root/testdata/sf0.001"


def plain(row):
    return tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_search.oracle_sql()))
def test_queries_agree_with_sql(spark, tables, name):
    df = queries_search.QUERIES[name](spark, DATA)
    cur = tables.execute(oracle_search.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want, got = sorted(map(plain, cur.fetchall()), key=str), sorted((plain(r[c] for c in columns) for r in df.collect()), key=str)
    assert len(want) > 0 and got == want


def test_dedup_over_whole_tables_against_a_loop(spark):
    catalog = queries_search.table_catalog(spark, DATA)
    c = {(0, r["candidate_id"], r["expression"]) for r in spark.read.parquet(f"{DATA}/candidates.parquet").collect()}
    p = {(1, r["proposal_id"], r["expression"]) for r in spark.read.parquet(f"{DATA}/measured_proposals.parquet").collect()}
    first, want = {}, {}
    for key in sorted(c | p, key=lambda k: (k[0], k[1], k[2] is not None, k[2] or "")):
        try:
            a = analyze(parse(key[2] or "", catalog))
            if a.rejection_reason:
                want[key[:2]] = ("rejected", None)
            elif a.semantic_fingerprint in first:
                want[key[:2]] = ("duplicate", first[a.semantic_fingerprint])
            else:
                first[a.semantic_fingerprint] = key[:2]
                want[key[:2]] = ("accepted", None)
        except ValueError:
            want[key[:2]] = ("invalid", None)
    got = {(r["source"], r["id"]): (r["status"], (r["first_source"], r["first_id"]) if r["first_id"] is not None else None) for r in queries_search.dedup_candidates(spark, DATA).collect()}
    assert got == want and {s for s, _ in want.values()} >= {"accepted", "duplicate"}
    known = set()
    for t, col in (("excluded_history", "entries"), ("measured_proposals", "semantic_fingerprint")):
        known |= {"".join(x for x in (r[col] or "").split(":", 1)[-1].lower() if x in "0123456789abcdef") for r in spark.read.parquet(f"{DATA}/{t}.parquet").collect()}
    alone, taken = set(), set()
    for i, e in sorted({(k[1], k[2]) for k in c}):
        a = analyze(parse(e, catalog))
        if a.semantic_fingerprint not in taken and not a.rejection_reason:
            taken.add(a.semantic_fingerprint)
            if a.semantic_fingerprint not in known:
                alone.add(i)
    assert {r["candidate_id"] for r in queries_search.dedup_new(spark, DATA).collect()} == alone


TEXTS = ["close", "open", "rank(close)", "rank(ts_mean(close, 5))", 'group_rank(ts_corr(close, volume, 90), group("sector"))', "if_else(greater(close, 1), rank(open), low)", "add(close, volume)", "ts_delta(add(open, low, high, close), 3)"]
STRUCT = "operator_shingles array<string>, operator_histogram map<string,int>, ordered_paths array<string>, fields array<string>, field_families array<string>, window_buckets map<string,int>, groups array<string>, nonlinear boolean, conditional boolean, lineage_parents array<string>"


def described(spark, n, pools=("a", "a", "b", None)):
    rng = np.random.default_rng(1)
    made = [(i, pools[rng.integers(len(pools))], describe(parse(TEXTS[rng.integers(len(TEXTS))]), [f"p{rng.integers(3)}"])) for i in range(n)]
    d = lambda x: tuple(list(v) if isinstance(v, tuple) else v for v in (x.operator_shingles, x.operator_histogram, x.ordered_paths, x.fields, x.field_families, x.window_buckets, x.groups, x.nonlinear, x.conditional, x.lineage_parents))
    return made, spark.createDataFrame([(i, p, d(x)) for i, p, x in made], f"id int, pool string, d struct<{STRUCT.replace(' ', ':').replace(',:', ',')}>")


@pytest.mark.parametrize("rows", [7, 20_000])
def test_novelties_of_pools_against_plain_loops(spark, monkeypatch, rows):
    monkeypatch.setattr(scoring, "POOL_ROWS", rows)
    made, df = described(spark, 60)
    archive = df.filter("id < 5").select("d", F.col("id").alias("place"))
    got = {r["id"]: r for r in scoring.novelty_components(df, "pool", [F.col("id")], "d", archive).collect()}
    assert len(got) == 60
    for p in {p for _, p, _ in made}:
        own = [(i, d) for i, q, d in made if q == p]
        for at, (i, d) in enumerate(own):
            peers = scoring.peers(at, len(own))
            assert got[i]["structural_novelty"] == pytest.approx(min(distance(d, own[j][1]) for j in peers)) and got[i]["archive_novelty"] == pytest.approx(min(distance(d, x) for j, _, x in made if j < 5))
    one = scoring.novelty_components(df.limit(1), "pool", [F.col("id")], "d").first()
    assert (one["structural_novelty"], one["archive_novelty"]) == (1.0, 1.0)
    assert scoring.novelty_components(df.limit(0), "pool", [F.col("id")], "d", archive).count() == 0


def test_retention_as_a_column(spark):
    made, df = described(spark, 30)
    got = {r["id"]: r["w"] for r in df.select("id", selection.retention_column("d").alias("w")).collect()}
    assert got == {i: engine.retention_value(d) for i, _, d in made}


def test_candidates_as_lines_keep_nulls_and_leave_out_other_columns(spark, tmp_path):
    df = spark.createDataFrame([(4, "r", "rank(close)", None, "x"), (4, None, "close", 0.5, "y")], "schema int, run_id string, expression string, structural_score double, extra string")
    artifacts.write_candidates(df, str(tmp_path / "lines"))
    back = artifacts.read_candidates(spark, str(tmp_path / "lines"))
    assert "extra" not in back.columns and sorted((r["run_id"] or "", r["expression"], r["structural_score"]) for r in back.collect()) == [("", "close", 0.5), ("r", "rank(close)", None)]
