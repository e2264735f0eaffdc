import json

import pytest

from panelforge import cli
from panelforge.expr.catalog import builtin
from panelforge.expr.descriptor import describe
from panelforge.expr.parser import parse
from panelforge.search import artifacts, dedup, engine, feedback, selection, session, transform
from panelforge.search.scoring import COMPONENTS, ScoreWeights, pool_components, weighted_score


def test_search_is_repeatable_resumes_and_spreads(spark, tmp_path):
    spec = engine.SearchSpec(seed=3, max_candidates=400, shortlist=20)
    a, m = engine.Search(spec).run()
    assert a == engine.Search(spec).run()[0] and len(a) == 20 and m["termination"] == "max_candidates" and m["counts"]["attempted"] == 400
    path = str(tmp_path / "check.json")
    _, paused = engine.Search(engine.SearchSpec(seed=3, max_candidates=400, shortlist=20, pause_after=1)).run(path)
    assert paused["termination"] == "checkpoint_pause"
    with open(path) as f:
        state = json.load(f)
    assert engine.Search(spec).run(resume=state)[0] == a
    assert engine.Search(spec, spark=spark).run()[0] == a
    with pytest.raises(artifacts.ArtifactError):
        engine.Search(engine.SearchSpec(seed=4)).run(resume=state)
    seen = {r["semantic_fingerprint"] for r in a}
    b, _ = engine.Search(spec, archive=[r["expression"] for r in a]).run()
    assert not seen & {r["semantic_fingerprint"] for r in b}
    assert all(set(r["score_components"]) == set(COMPONENTS) for r in a)
    with pytest.raises(ValueError):
        engine.SearchSpec(shortlist=0).checked()


class Clock:
    """A second passes whenever it is looked at."""

    def __init__(self):
        self.now = 0.0

    def __call__(self):
        self.now += 1.0
        return self.now


@pytest.mark.parametrize(("seconds", "generations"), [(1.0, 0), (8.0, 4), (40.0, 20)])
def test_a_deadline_ends_generations_and_fills_the_shortlist_in_order(seconds, generations):
    search = engine.Search(engine.SearchSpec(seed=3, max_candidates=10_000_000, shortlist=10, seconds=seconds, batch=32), clock=Clock())
    out, m = search.run()
    assert m["termination"] == "duration_deadline" and m["counts"]["generations"] == generations and m["counts"]["attempted"] == 64 + 32 * generations
    cover = [r for r in out if r["provenance"]["operation"] in transform.COVERS]
    made = {d.semantic: d for d in search.population[:20]}
    others = sum(d.provenance.operation not in transform.COVERS for d in made.values())
    assert len(cover) <= 5 and len(out) == len(cover) + min(10 - len(cover), others) and {r["semantic_fingerprint"] for r in out} <= set(made)
    assert len(out) == 10 or not generations


def test_elites_are_kept_in_turns_of_buckets_by_worth():
    drafts = []
    for text in ["close", "open", "rank(close)", "rank(ts_mean(close, 5))", 'group_rank(ts_corr(close, volume, 90), group("sector"))', "if_else(greater(close, 1), rank(open), low)", "add(close, volume)", "add(open, low, high, close)", "rank(volume)"]:
        made = engine.prepare(parse(text), transform.Provenance("mutation" if "rank" in text else "initial", "x"), transform.Limits(), builtin())
        drafts.append(engine.Draft(made, 0, {}))
    worth = {d.text: engine.retention_value(d.descriptor) for d in drafts}
    assert worth["close"] == 7 + 3 and worth["rank(close)"] == 5 + 7 + 3 + 3 and worth["rank(ts_mean(close, 5))"] == 8 + 2 * 5 + 7 + 3 + 4 + 3
    for limit in range(1, 10):
        queues = {}
        for d in drafts:
            queues.setdefault(d.bucket, []).append(d)
        queues = [sorted(queues[k], key=lambda d: (-worth[d.text], d.nodes, d.semantic)) for k in sorted(queues)]
        want = [q[i].text for i in range(9) for q in queues if i < len(q)][:limit]
        kept = engine.Elites(limit, drafts)
        kept.bound()
        assert sorted(d.text for d in kept) == sorted(want) and len(kept) == limit


def test_guided_and_seeded_search():
    spec = engine.SearchSpec(seed=2, max_candidates=300, shortlist=12)
    first, _ = engine.Search(spec).run()
    archive = [r["expression"] for r in first]
    records = tuple(feedback.Record(str(i), {"depth": float(r["depth"]), "nodes": float(r["nodes"])}, 0.9 if r["provenance"]["kind"] == "mutation" else -0.9, 1.0, r["semantic_fingerprint"]) for i, r in enumerate(first))
    data = feedback.FeedbackDataset("d", "c", "o", SCALES, records)
    guide = engine.neighbour_guidance(data, feedback.FeedbackConfig(3, 1))
    policy = engine.action_policy(first, data, feedback.PolicyConfig(minimum_support=1))
    assert policy.mutation == 15 and policy.crossover <= 20
    seeded = engine.SearchSpec(seed=2, max_candidates=300, shortlist=12, seed_from_archive=True, freeze_parents=True, feedback_elites=4)
    run = lambda: engine.Search(seeded, archive=archive, guidance=guide, policy=policy).run()[0]
    out = run()
    assert out == run() and not {r["expression"] for r in out} & set(archive) and all(r["provenance"]["kind"] != "initial" for r in out)
    for bad in ({"guidance": None, "archive": archive}, {"guidance": guide, "archive": None}):
        with pytest.raises(ValueError):
            engine.Search(seeded, policy=policy, **bad)


def test_publication_and_reading(spark, tmp_path):
    records, manifest = engine.Search(engine.SearchSpec(seed=1, max_candidates=200, shortlist=10)).run()
    out = str(tmp_path / "c.jsonl")
    artifacts.publish(out, records, manifest)
    assert artifacts.read_published(out)[0] == json.loads(json.dumps(records))
    assert artifacts.read_candidates(spark, out).count() == 10
    with pytest.raises(artifacts.ArtifactError):
        artifacts.publish(out, [{**records[0], "run_id": "other"}], manifest)
    with open(out, "a") as f:
        f.write('\n{"schema": 9}\n')
    with pytest.raises(artifacts.ArtifactError, match="line 12"):
        artifacts.load_candidates(out)
    with pytest.raises(Exception, match="not a candidate"):
        artifacts.read_candidates(spark, out).collect()


def test_dedup_partition(spark):
    texts = ["rank(close)", "rank(rank(close))", "subtract(close, close)", "rank(", None, "multiply(2, rank(close))", "add(open, close)", "add(close, open)"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "n int, e string")
    rows = {r["n"]: r for r in dedup.partition(df, "n", "e").collect()}
    assert [rows[i]["status"] for i in range(1, 9)] == ["accepted", "duplicate", "rejected", "invalid", "invalid", "duplicate", "accepted", "duplicate"]
    assert rows[2]["duplicate_of"] == 1 and rows[8]["duplicate_of"] == 7 and rows[3]["reason"] == "provably_zero"
    assert dedup.partition(df.limit(0), "n", "e").count() == 0
    known = spark.createDataFrame([(rows[1]["analysis"]["semantic_fingerprint"],)], "f string")
    assert [r["n"] for r in dedup.new_only(dedup.partition(df, "n", "e"), known, "f").collect()] == [7]
    assert dedup.rejection_counts(dedup.partition(df, "n", "e")).collect()[0]["n"] == 1


def test_field_caps_and_round_robin(spark):
    df = spark.createDataFrame([(i, "ab" if i < 6 else f"f{i}") for i in range(10)], "i int, f string")
    status = {r["i"]: r["status"] for r in selection.field_diverse(df, ["i"], "f", 4, 2).collect()}
    assert [status[i] for i in range(10)] == ["selected", "selected", "deferred", "deferred", "deferred", "deferred", "selected", "selected", "remaining", "remaining"]
    got = selection.round_robin(df, ["f"], [df["i"].asc()], 7).orderBy("place").collect()
    assert [r["i"] for r in got] == [0, 6, 7, 8, 9, 1, 2]
    assert [r["b"] for r in df.select(selection.node_bucket(df["i"] * 13).alias("b")).collect()] == [0, 2, 3, 3, 4, 4, 4, 4, 5, 5]


def test_scores_of_pools(spark):
    df = spark.createDataFrame([("add", "mutation", 10, 3, ["a", "b", "a"]), ("add", "initial", 5, 1, None), (None, "initial", 5, 1, [])], "root_family string, kind string, nodes int, operator_count int, parents array<string>")
    rows = pool_components(df).orderBy("nodes", "root_family").collect()
    assert len(rows) == 3 and rows[2]["lineage_diversity"] == 1.0 and rows[2]["simplicity"] == pytest.approx(1 / 5) and rows[2]["family_diversity"] == pytest.approx(2**-0.5)
    from pyspark.sql import functions as F

    full = pool_components(df).withColumns({"archive_novelty": F.lit(1.0), "structural_novelty": F.lit(0.5)})
    assert all(0 < r["structural_score"] <= 1 for r in weighted_score(full).collect())
    with pytest.raises(ValueError):
        ScoreWeights(-1).normalized()


SCALES = {"depth": 10.0, "nodes": 40.0}


def dataset(name="d", shift=0, n=6):
    records = tuple(feedback.Record(f"{name}{i}", {"depth": float(i + shift), "nodes": float(4 * i)}, -0.9 + 0.36 * i, 1.0, None) for i in range(n))
    return feedback.FeedbackDataset(name, "ctx", "outcome", SCALES, records).checked()


def test_guidance_against_plain_loops(spark):
    d, config = dataset(), feedback.FeedbackConfig(3, 2, 0.5)
    f = d.frame(spark)
    for block in (2, 4096):
        near = feedback.neighbours(f.select("id", "vec"), f, d.scales, config, True, block)
        got = {r["query"]: r for r in feedback.estimates(near, config).collect()}
        for r in d.records:
            ds = sorted((sum(min(abs(r.features[k] - o.features[k]) / SCALES[k], 1) for k in SCALES) / 2, o.record_id, o.outcome) for o in d.records if o is not r)
            ds = [x for x in ds if x[0] <= 0.5][:3]
            w = [max(1 - x[0], 1e-9) ** 2 for x in ds]
            mean = sum(a * x[2] for a, x in zip(w, ds)) / sum(w)
            assert got[r.record_id]["weighted_outcome"] == pytest.approx(mean) and got[r.record_id]["neighbors"] == len(ds)
    m = feedback.audit_metrics(feedback.leave_one_out(f, d.scales, config)).first()
    assert m["records"] == 6 and m["coverage"] == 1.0 and 0 <= m["auc"] <= 1
    h = feedback.holdout(d, dataset("e", 1, 3), config, spark).collect()
    assert [r["id"] for r in h] == ["e0", "e1", "e2"]
    with pytest.raises(feedback.FeedbackError):
        feedback.holdout(d, d, config, spark)


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, -1.0), (0.1, 1.0), (0.5, 1.0), (0.0, -1.0)], "p double, a double")
    assert feedback.rank_auc(df, "p", "a").first()["auc"] == pytest.approx(3.5 / 4)
    assert feedback.rank_auc(df.filter("a > 0"), "p", "a").first()["auc"] is None


def test_features_agree_in_both_forms(spark):
    texts = ["rank(ts_mean(close, 5))", 'group_rank(ts_corr(close, volume, 100), group("sector"))', "if_else(greater(close, 1), open, clip(low, lower=0, upper=1))"]
    rows, want = [], []
    for t in texts:
        n = parse(t)
        d = describe(n, ["p"])
        want.append(feedback.features(d, n.operator, n.node_count, n.depth))
        rows.append((t, n.operator, n.node_count, n.depth, (list(d.operator_shingles), d.operator_histogram, list(d.fields), list(d.field_families), d.window_buckets, list(d.groups), d.nonlinear, d.conditional, list(d.lineage_parents))))
    schema = "t string, root string, nodes int, depth int, d struct<operator_shingles:array<string>,operator_histogram:map<string,int>,fields:array<string>,field_families:array<string>,window_buckets:map<string,int>,groups:array<string>,nonlinear:boolean,conditional:boolean,lineage_parents:array<string>>"
    got = {r["t"]: r["m"] for r in spark.createDataFrame(rows, schema).select("t", feedback.feature_map("d", "root", "nodes", "depth").alias("m")).collect()}
    assert len(feedback.FEATURES) == 97 and all(got[t] == w for t, w in zip(texts, want))


def test_operator_policy():
    scales = {"operator_rank_count": 1.0, "operator_ts_mean_count": 1.0}
    records = tuple(feedback.Record(str(i), {"operator_rank_count": float(i < 3), "operator_ts_mean_count": float(i >= 3)}, 0.8 if i < 3 else -0.8, 1.0) for i in range(6))
    _, weights = feedback.reweighted(builtin(), feedback.FeedbackDataset("d", "c", "o", scales, records))
    assert weights["rank"] == 30 and weights["ts_mean"] == 15 and weights["abs"] == 10
    with pytest.raises(feedback.FeedbackError):
        feedback.FeedbackConfig(0).checked()


def config(**kw):
    return session.SessionConfig(**{"evaluator_context": "e", "seed": 1, "batch_size": 4, "max_evaluations": 12, "parent_capacity": 3, **kw}).checked()


def told(s):
    return {p.semantic_fingerprint: float(p.ordinal % 5) for p in s.score_requests()}


@pytest.mark.parametrize("policy", session.PARENT_POLICIES)
def test_sessions_run_out_and_resume_bit_by_bit(policy):
    c = config(parent_selection=policy, exploration_policy="grammar", mutation_policy="applicable")
    s, other = session.Session(c), session.Session(c)
    rounds = 0
    while s.ask():
        assert s.ask() == s.ask() == other.ask()
        s.tell("e", "pool", told(s))
        other = session.Session.restore(other.checkpoint(), c)
        other.tell("e", "pool", list(reversed(told(other).items())))
        assert s.checkpoint() == other.checkpoint() and len(s.parents) <= 3
        rounds += 1
    assert rounds == 3 and s.counters()["measured"] == 12


def test_sessions_reject_bad_snapshots_and_screen():
    s = session.Session(config())
    s.ask()
    before = s.checkpoint()
    scores = told(s)
    key = next(iter(scores))
    for bad in ((("x", "pool", scores)), ("e", " ", scores), ("e", "pool", {k: v for k, v in scores.items() if k != key}), ("e", "pool", {**scores, key: float("nan")}), ("e", "pool", [*scores.items(), (key, 1.0)]), ("e", "pool", {**scores, "0" * 64: 1.0})):
        with pytest.raises(session.SessionError):
            s.tell(*bad)
    assert s.checkpoint() == before
    s.tell_screened("e", "pool", {key: 1.0})
    assert s.counters()["measured"] == 1 and s.counters()["screened_out"] == 3
    with pytest.raises(session.SessionError):
        session.Session.restore(before.replace("semantic_fingerprint", "semantic", 1), config())
    with pytest.raises((session.SessionError, TypeError)):
        session.Session.restore(before, config(seed=9))


def test_seeds_history_and_the_bridge():
    seeds = [{"record_id": "a", "expression": "rank(close)", "outcome": 0.2}, {"record_id": "b", "expression": "ts_mean(open, 5)", "outcome": 0.1}]
    history = session.ExcludedHistory(frozenset(["0" * 64])).checked()
    c = config(max_evaluations=32, batch_size=8)
    s = session.Session.from_measured(c, seeds, history)
    for _ in range(4):
        s.ask()
        best = [p.semantic_fingerprint for p in s.pending][:2]
        s.tell_screened("e", "pool", {**{p.semantic_fingerprint: v for p, v in s.parents}, **dict.fromkeys(best, 0.5)})
    assert s.counters() == {**s.counters(), "imported": 2, "measured": 8, "screened_out": 24} and s.ask() == []
    assert session.Session.restore(s.checkpoint(), c, history=history).checkpoint() == s.checkpoint()
    with pytest.raises(session.SessionError):
        session.Session.restore(s.checkpoint(), c)
    with pytest.raises(session.SessionError):
        session.Session.from_measured(c, [*seeds, {"record_id": "c", "expression": "rank(rank(close))", "outcome": 0.1}])
    out = []
    session.serve([json.dumps(x) for x in ({"op": "ask"}, {"op": "init", "config": {"evaluator_context": "e", "batch_size": 2}}, {"op": "ask"}, {"op": "checkpoint"}, {"op": "nope"})] + ["", "{"], out.append)
    got = [json.loads(x) for x in out]
    assert [g["ok"] for g in got] == [False, True, True, True, False, False] and len(got[2]["proposals"]) == 2


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: cli.main(list(a))
    assert run("doctor") == 0 and run("inspect", "rank(rank(close))") == 0
    assert '"semantic_canonical": "rank(close)"' in capsys.readouterr().out
    out = str(tmp_path / "c.jsonl")
    assert run("search", "--output", out, "--candidates", "150", "--shortlist", "8") == 0
    assert run("dedup", "--input", out, "--output", str(tmp_path / "d.jsonl")) == 0
    assert len(artifacts.load_candidates(str(tmp_path / "d.jsonl"))[0]) == 8
    assert run("benchmark", "--candidates", "100", "--spread") == 0 and run("inspect", "rank(") == 1
    with pytest.raises(SystemExit):
        run("dedup", "--input", out, "--output", out)
    panel = {"schema": 1, "dataset_id": "d", "source_label": "s", "timestamps": list(range(16)), "assets": ["a", "b"], "fields": {k: {"values": [float((i * 7) % 11) for i in range(32)]} for k in ("close", "volume")}, "realized_returns": {"values": [0.01 * (-1) ** i for i in range(32)]}, "groups": {"sector": ["x", "y"]}}
    (tmp_path / "p.json").write_text(json.dumps(panel))
    options = ["--panel", str(tmp_path / "p.json"), "--train-end", "6", "--validation-end", "10"]
    assert run("evaluate", "rank(close)", *options) == 0
    assert run("evaluate-batch", "--input", out, "--output", str(tmp_path / "e.jsonl"), *options) == 0
    data = {"schema": 1, "dataset_id": "f", "context_checksum": "c", "outcome_label": "o", "feature_scales": SCALES, "records": [{"record_id": str(i), "features": {"depth": float(i), "nodes": 3.0 * i}, "outcome": 0.1 * i - 0.3, "confidence": 1.0} for i in range(8)]}
    (tmp_path / "f.json").write_text(json.dumps(data))
    fb = ["--feedback", str(tmp_path / "f.json")]
    assert run("prioritize", "--input", out, *fb, "--output", str(tmp_path / "g.jsonl")) == 0
    assert run("screen-feedback", "--input", out, *fb, "--threshold", "0.0", "--output", str(tmp_path / "h.jsonl")) == 0
    assert run("audit-feedback", *fb) == 0
    (tmp_path / "x.json").write_text(json.dumps({"schema": 1, "name": "t", "allowed_operators": ["rank", "multiply"], "allowed_fields": ["close"], "unary_scalar_lowerings": {"negate": {"replacement": "multiply", "scalar": -1}}}))
    assert run("compile", "negate(rank(close))", "--dialect", str(tmp_path / "x.json")) == 0
