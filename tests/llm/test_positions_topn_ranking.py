import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from panelforge.llm import ranking, topn
from panelforge.llm._positions import positions


def brute(rows, keep=None):
    out, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        if keep is None or seen[g] <= keep:
            out[i] = seen[g]
    return out


@pytest.mark.parametrize("keep", [None, 3])
def test_positions_of_groups_over_many_partitions(spark, keep):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(20), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["i"]: r["p"] for r in positions(df, ["g"], [F.col("v").asc(), F.col("i").asc()], "p", keep=keep).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows, keep)


def test_positions_sum_weights_and_take_empty_input(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 2)], "g string, v int, w long")
    assert sorted((r["g"], r["v"], r["s"]) for r in positions(df, ["g"], [F.col("v").asc()], "s", weight="w").collect()) == [("a", 1, 5), ("a", 2, 12), ("b", 1, 2)]
    assert positions(df.limit(0), ["g"], [F.col("v").asc()], "p").count() == 0


CANDIDATE = "candidate_id long, run_id string, root_family string, structural_score double, nodes int, fingerprint string, written_at int, score_components struct<simplicity:double,archive_novelty:double,structural_novelty:double,transform_diversity:double>, extra string"


def candidates(spark, rows):
    return spark.createDataFrame([(i, r, f, s, n, p, w, c, "x") for i, r, f, s, n, p, w, c in rows], CANDIDATE)


def test_top_n_settles_ties_and_leaves_out_the_unusable(spark):
    rows = [
        (1, "r", " ADD", 0.5, 3, "b", 1, None), (1, "r", " ADD", 0.1, 3, "b", 0, None), (2, "r", "add", 0.5, 2, "z", 1, None), (3, "r", "Add\t", 0.5, 3, "a", 1, None), (4, "r", "add", 0.4, 1, "a", 1, None),
        (5, "r", None, 0.9, 1, "a", 1, None), (6, "r", "add", float("nan"), 1, "a", 1, None), (7, "r", "add", None, 1, "a", 1, None), (2, "r", "add", 0.5, 2, "z", 1, None), (8, None, "add", 0.2, None, None, None, None), (None, "r", "add", 1.0, 1, "a", 1, None),
    ]
    got = topn.top_candidates(candidates(spark, rows), 3).orderBy("run_id", "position").collect()
    assert [(r["run_id"], r["root_family"], r["candidate_id"]) for r in got] == [(None, "add", 8), ("r", "add", 2), ("r", "add", 3), ("r", "add", 1)]
    assert topn.top_candidates(candidates(spark, []), 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_candidates(candidates(spark, rows), 0)


def test_inverse_normal_agrees_with_the_standard_library(spark):
    ps = [1e-12, 1e-6, 0.01, 0.075, 0.3, 0.5, 0.6, 0.925, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(ranking.inverse_normal(F.col("p")).alias("z")).collect()
    assert all(math.isclose(r["z"], NormalDist().inv_cdf(p), rel_tol=1e-9, abs_tol=1e-12) for r, p in zip(got, ps))


def test_ranking_weighs_scales_alike_and_keeps_every_item(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        a, b = rng.choice([1.0, 2.0, 3.0]), rng.random() * 1e6
        rows.append((i, "r", "add", 0.5, 1, "a", 1, (a, None if i == 7 else b, float("nan") if i == 8 else rng.random(), rng.random())))
    rows.append((99, "r", "add", 0.5, 1, "a", 1, None))
    df = ranking.component_table(candidates(spark, rows))
    got = {r["candidate_id"]: r for r in ranking.score_ranking(df, "run_id", "candidate_id", ranking.SCORES).collect()}
    assert len(got) == 61 and sorted(r["position"] for r in got.values()) == list(range(1, 62))
    assert got[99]["position"] == 61 and got[99]["combined"] is None and got[7]["n_scores"] == 3
    names = list(ranking.SCORES)
    expected = {}
    for i, *_, c in rows:
        if c is None:
            continue
        zs = []
        for k in range(len(names)):
            values = [r[-1][k] for r in rows if r[-1] is not None and r[-1][k] is not None and r[-1][k] == r[-1][k]]
            if c[k] is not None and c[k] == c[k]:
                zs.append(NormalDist().inv_cdf((sum(v < c[k] for v in values) + values.count(c[k]) / 2) / len(values)))
        expected[i] = sum(zs) / len(zs)
    assert all(math.isclose(got[i]["combined"], v, abs_tol=1e-8) for i, v in expected.items())
    assert ranking.score_ranking(df.limit(0), "run_id", "candidate_id", ranking.SCORES).count() == 0


def test_leaders_are_strictly_in_the_top_twentieth(spark):
    rows = [(i, "r", "add", 0.5, 1, "a", 1, (float(i), float(i), float(i), float(i))) for i in range(40)] + [(100, "r", "add", 0.5, 1, "a", 1, (1e9, 1e9, 1e9, None))]
    got = sorted(r["candidate_id"] for r in ranking.leaders(candidates(spark, rows)).collect())
    # three scores have 41 usable values, one above 39; the last has 40
    assert got == [i for i in range(40) if all(20 * (40 - 1 - i + (k < 3)) < (41 if k < 3 else 40) for k in range(4))]
