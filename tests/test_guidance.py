import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge import queries_core
from panelforge.plans.numbering import placed_within
from panelforge.search import feedback, guidance

DATA = "/root/testdata/sf0.01"


def moved(spark):
    """Bytes written by shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_feedback_guided_moves_little_more_than_its_input(spark):
    before = moved(spark)
    assert queries_core.feedback_guided(spark, DATA).write.format("noop").mode("overwrite").save() is None
    read = sum(os.path.getsize(f"{DATA}/{n}.parquet") for n in ("candidates", "feedback_records", "feedback_datasets"))
    assert 0 < moved(spark) - before < 4 * read


@pytest.mark.parametrize("width, k, most", [(10_000, 3, 0.5), (64, 8, 1.0), (64, 200, 0.7)])
def test_nearest_of_blocks_against_brute_force(width, k, most):
    r = np.random.default_rng(5)
    scale = np.array([0.5, 1.0, 3.0, 8.0, 64.0])
    x, y = np.floor(r.exponential(3, (300, 5))), np.round(r.exponential(3, (500, 5)) * 4) / 4
    x[:40], y[100:160], y[300:310] = r.normal(0, 2, (40, 5)), x[50:110], y[0]
    outcome, confidence, rank = r.uniform(-1, 1, 500), r.uniform(0.1, 1, 500), r.permutation(500)
    met = guidance.Nearest(x, scale, k, most)
    met.width = width
    for at in (0, 7, 210):
        to = {0: 7, 7: 210, 210: 500}[at]
        met.meet(y[at:to], rank[at:to], outcome[at:to], confidence[at:to])
    for i in range(len(x)):
        d = np.zeros(500)
        for f, s in enumerate(scale):
            d += np.minimum(np.abs(y[:, f] - x[i, f]) / s, 1.0)
        d /= 5
        want = [j for j in np.lexsort((rank, d)) if d[j] <= most][:k]
        own = met.row == i
        assert met.rank[own].tolist() == rank[want].tolist() and met.distance[own].tolist() == d[want].tolist() and met.outcome[own].tolist() == outcome[want].tolist()


def test_slices_and_blocks_of_any_size_guide_alike(spark):
    rows, guides, names = queries_core._feedback(spark, "/root/testdata/sf0.001")
    keys = {r["dataset_id"]: r["keys"] for r in names.collect()}
    candidates, features = queries_core._guidable(spark, "/root/testdata/sf0.001")
    # some candidates have fingerprints of records
    known = [r["fingerprint"] for r in rows.filter("fingerprint is not null").orderBy("id").limit(5).collect()]
    candidates = candidates.withColumn("fingerprint", F.when(F.col("candidate_id") % 5 == 0, F.element_at(F.array(*map(F.lit, known)), (F.col("candidate_id") % 25 / 5 + 1).cast("int"))).otherwise(F.col("fingerprint")))
    got = []
    for slice_, block in ((guidance.SLICE, guidance.BLOCK), (7, 5)):
        met, by = guidance.guided_by_all(candidates, features, rows, guides, keys, slice_, block)
        got.append(sorted(str((by[r["dataset"]], r["candidate_id"], r["exact"], r["neighbors"], *(None if r[c] is None else round(r[c], 9) + 0.0 for c in ("mean_distance", "weighted_outcome", "dispersion", "conservative_outcome")))) for r in met.collect()))
    assert got[0] == got[1] and any(", True, 1, 0.0" in g for g in got[0])
    # the same from the candidates of one dataset at a time
    d = sorted(guides)[0]
    at = [features.index(k) for k in keys[d]]
    one = candidates.select(F.col("candidate_id").cast("string").alias("id"), "fingerprint", F.when(F.col("vec").isNotNull(), F.array(*(F.get("vec", i) for i in at))).alias("vec"))
    want = {int(r["id"]): r for r in feedback.guided(one, rows.filter(F.col("dataset_id") == d).drop("dataset_id"), *guides[d]).collect()}
    met, by = guidance.guided_by_all(candidates, features, rows, guides, keys)
    own = [r for r in met.collect() if by[r["dataset"]] == d]
    assert len(own) == len(want)
    for r in own:
        w = want[r["candidate_id"]]
        assert (r["exact"], r["neighbors"]) == (w["exact"], w["neighbors"]) and all(r[c] == pytest.approx(w[c], abs=1e-9) for c in ("mean_distance", "weighted_outcome", "dispersion", "conservative_outcome") if w[c] is not None)


@pytest.mark.parametrize("rows", [2**17, 64])
def test_places_within_groups_are_those_of_one_sort(spark, rows, tmp_path):
    spark.range(3000).select(F.pmod("id", F.lit(3)).cast("int").alias("g"), F.pmod(F.col("id") * 7919, F.lit(11)).cast("double").alias("v"), "id").filter("g < 2 or id < 4").write.parquet(str(tmp_path / "t"))
    got = placed_within(spark.read.parquet(str(tmp_path / "t")), "g", {"v": F.col("v"), "i": -F.col("id")}, "place", rows).collect()
    assert len(got) == 2000 + sum(i % 3 == 2 for i in range(4))
    for g in range(3):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own))) and [r["id"] for r in own] == [r["id"] for r in sorted(own, key=lambda r: (r["v"], -r["id"]))]
