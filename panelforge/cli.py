"""Command line: python -m panelforge.cli COMMAND ... (see --help)."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
import time

from panelforge import __version__
from panelforge.expr.analysis import analyze
from panelforge.expr.canonical import canonical, fingerprint
from panelforge.expr.catalog import Catalog, builtin
from panelforge.expr.descriptor import Descriptor, describe
from panelforge.expr.parser import parse
from panelforge.expr.rewrite import Dialect, compile_dialect, reduce_unit_scaling
from panelforge.search import artifacts


def _spark(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(f"panelforge {name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _catalog(args) -> Catalog:
    return Catalog.from_json(_text(args.catalog)) if getattr(args, "catalog", None) else builtin()


def _distinct(a: str, b: str) -> None:
    if os.path.abspath(a) == os.path.abspath(b):
        raise SystemExit("input and output must differ")


def _show(value: object) -> None:
    print(json.dumps(value, indent=1, sort_keys=True, default=str))


def doctor(args) -> None:
    c = builtin()
    node = parse("rank(ts_delta(close, 2))")
    _show({"version": __version__, "catalog_checksum": c.checksum, "operators": len(c.operators), "round_trip": canonical(parse(canonical(node))) == canonical(node), "ok": True})


def inspect(args) -> None:
    c = _catalog(args)
    node = parse(args.expression, c)
    if args.reduce_unit_scaling:
        node = reduce_unit_scaling(node)
    a = analyze(node)
    _show({"canonical": canonical(node), "fingerprint": fingerprint(node), **a.__dict__, "nodes": node.node_count, "depth": node.depth, "operators": node.operator_count, "descriptor": describe(node, (), c).to_dict()})


def dedup(args) -> None:
    from panelforge.search.dedup import partition

    _distinct(args.input, args.output)
    records, sha = artifacts.load_candidates(args.input)
    spark = _spark("dedup")
    df = spark.createDataFrame([(i + 1, r["expression"]) for i, r in enumerate(records)], "record int, expression string")
    rows = partition(df, "record", "expression", _catalog(args)).orderBy("record").collect()  # a file read on the driver
    bad = next((r for r in rows if r["status"] == "invalid"), None)
    if bad:
        raise SystemExit(f"record {bad['record']}: {bad['reason']}")
    kept = []
    for r in rows:
        if r["status"] == "accepted":
            a = r["analysis"]
            kept.append({**records[r["record"] - 1], "schema": artifacts.SCHEMA, "expression": a["canonical"], "fingerprint": a["fingerprint"], "semantic_fingerprint": a["semantic_fingerprint"], "nodes": a["nodes"], "depth": a["depth"]})
    artifacts.write_jsonl(args.output, kept)
    reasons: dict[str, int] = {}
    for r in rows:
        if r["status"] == "rejected":
            reasons[r["reason"]] = reasons.get(r["reason"], 0) + 1
    _show({"input_sha256": sha, "records": len(rows), "accepted": len(kept), "duplicates": sum(r["status"] == "duplicate" for r in rows), "rejected": reasons})


def _spec(args):
    from panelforge.search.engine import SearchSpec

    return SearchSpec(seed=args.seed, max_candidates=args.candidates, shortlist=args.shortlist, seconds=args.seconds, cover=args.cover, pause_after=args.pause_after, batch=args.batch)


def search(args) -> None:
    from panelforge.search.engine import Search

    archive = [r["expression"] for r in artifacts.load_candidates(args.archive)[0]] if args.archive else []
    if args.archive:
        _distinct(args.archive, args.output)
    s = Search(_spec(args), _catalog(args), archive, _spark("search") if args.spread else None)
    records, manifest = s.run(args.checkpoint, json.loads(_text(args.resume)) if args.resume else None)
    _show({**artifacts.publish(args.output, records, manifest), "manifest": manifest})


def benchmark(args) -> None:
    from panelforge.search.engine import Search

    spark = _spark("benchmark") if args.spread else None
    began = time.monotonic()
    _, manifest = Search(_spec(args), spark=spark).run()
    seconds = time.monotonic() - began
    _show({"seconds": round(seconds, 3), "candidates_per_second": round(manifest["counts"]["attempted"] / seconds, 1), "counts": manifest["counts"]})


def _guided(args, spark):
    from panelforge.search import feedback

    records, _ = artifacts.load_candidates(args.input)
    data = feedback.FeedbackDataset.from_json(_text(args.feedback))
    config = feedback.FeedbackConfig(args.neighbors, args.minimum_neighbors, args.maximum_distance).checked()
    keys = sorted(data.feature_scales)
    rows = []
    for i, r in enumerate(records):
        d = {k: tuple(v) if isinstance(v, list) else v for k, v in r["structural_descriptor"].items()}
        f = feedback.features(Descriptor(**d), r["root_family"], r["nodes"], r["depth"])
        rows.append((str(i), r["semantic_fingerprint"], [f[k] for k in keys], float(r["structural_score"])))
    df = spark.createDataFrame(rows, "id string, fingerprint string, vec array<double>, structural_score double")
    return records, feedback.guided(df, data.frame(spark), data.scales, config)


def prioritize(args) -> None:
    from panelforge.search.feedback import guidance_order

    _distinct(args.input, args.output)
    records, rows = _guided(args, _spark("prioritize"))
    out = [{"candidate": records[int(r["id"])], "guidance": {k: r[k] for k in ("neighbors", "mean_distance", "weighted_outcome", "dispersion", "conservative_outcome", "exact")}} for r in rows.orderBy(*guidance_order()).collect()]
    artifacts.write_jsonl(args.output, out)
    _show({"candidates": len(out), "guided": sum(o["guidance"]["conservative_outcome"] is not None for o in out)})


def screen_feedback(args) -> None:
    from panelforge.search.feedback import screened

    records, rows = _guided(args, _spark("screen"))
    out = sorted(({"position": int(r["id"]), "expression": records[int(r["id"])]["expression"], "conservative_outcome": r["conservative_outcome"], "eligible": r["eligible"]} for r in screened(rows, args.threshold).collect()), key=lambda x: x["position"])
    meta = {"schema": 1, "threshold": args.threshold, "candidates": len(out), "eligible": sum(o["eligible"] for o in out)}
    if args.output:
        _distinct(args.input, args.output)
        artifacts.write_jsonl(args.output, [{"metadata": meta}, *({"candidate": o} for o in out)])
    _show({**meta, "rows": out} if not args.output else meta)


def audit_feedback(args) -> None:
    from panelforge.search import feedback

    spark = _spark("audit")
    data = feedback.FeedbackDataset.from_json(_text(args.feedback))
    config = feedback.FeedbackConfig(args.neighbors, args.minimum_neighbors, args.maximum_distance).checked()
    rows = feedback.holdout(data, feedback.FeedbackDataset.from_json(_text(args.evaluation)), config, spark) if args.evaluation else feedback.leave_one_out(data.frame(spark), data.scales, config)
    _show(feedback.audit_metrics(rows).first().asDict())


def compile_(args) -> None:
    _show(compile_dialect(args.expression, Dialect.from_json(_text(args.dialect)), _catalog(args)).__dict__)


def _config(args):
    from panelforge.operators.evaluation import EvaluationConfig

    return EvaluationConfig(args.train_end, args.validation_end, args.evaluation_start, args.horizon, args.cost_bps, args.annualization_rows, args.signal_decay, args.truncation, args.daily, args.proxy)


def evaluate(args) -> None:
    from panelforge.operators import evaluation
    from panelforge.sources import panels

    _show(evaluation.evaluate(args.expression, panels.from_json(_spark("evaluate"), _text(args.panel)), _config(args), _catalog(args)))


def evaluate_batch(args) -> None:
    from panelforge.operators import evaluation
    from panelforge.sources import panels

    _distinct(args.input, args.output)
    if os.path.exists(args.output):
        raise SystemExit(f"{args.output} exists")
    records, sha = artifacts.load_candidates(args.input)
    out = evaluation.evaluate_batch([r["expression"] for r in records], panels.from_json(_spark("evaluate-batch"), _text(args.panel)), _config(args), _catalog(args))
    artifacts.write_jsonl(args.output, out, overwrite=False)
    _show({"input_sha256": sha, "records": len(out), "succeeded": sum(r["status"] == "succeeded" for r in out), "failed": sum(r["status"] == "failed" for r in out)})


def prepare_panel(args) -> None:
    from panelforge.sources import panels, universe

    day = dt.date.fromisoformat
    start, evaluation, train, validation, end = map(day, (args.start, args.evaluation_start, args.train_end, args.validation_end, args.end))
    if not start < evaluation < train < validation <= end:
        raise SystemExit("dates must be ordered: start < evaluation-start < train-end < validation-end <= end")
    if os.path.exists(args.output):
        raise SystemExit(f"{args.output} exists")
    panel = universe.prepare(_spark("prepare-panel"), args.root, universe.UniverseConfig(start, end, args.universe_size, args.dataset_id)).checked()
    if args.output.endswith(".json"):
        artifacts.write_atomically(args.output, panels.to_json(panel).encode(), overwrite=False)
    else:
        panel.df.write.parquet(args.output)
    rows = {n: universe.first_row_on_or_after(panel, d) for n, d in (("evaluation_start", evaluation), ("train_end", train), ("validation_end", validation))}
    _show({"rows": panel.rows, "assets": panel.assets, **rows})


def session(args) -> None:
    from panelforge.search.session import serve

    serve(sys.stdin, lambda s: (sys.stdout.write(s), sys.stdout.flush()))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="panelforge", description="Formula queries over time x asset panels, on Spark.")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for o in options:
            p.add_argument(o[0], **o[1])

    need = lambda *names: [(n, {"required": True}) for n in names]
    may = lambda **kw: [("--" + k.replace("_", "-"), v) for k, v in kw.items()]
    catalog = may(catalog={})
    run_options = may(seed={"type": int, "default": 0}, candidates={"type": int, "default": 1000}, shortlist={"type": int, "default": 100}, seconds={"type": float}, cover={"default": "fixed"}, pause_after={"type": int}, batch={"type": int, "default": 128}, spread={"action": "store_true"})
    near = may(neighbors={"type": int, "default": 8}, minimum_neighbors={"type": int, "default": 3}, maximum_distance={"type": float, "default": 1.0})
    evaluation = [*need("--panel"), *[(o, {"required": True, "type": int}) for o in ("--train-end", "--validation-end")], *may(
        evaluation_start={"type": int, "default": 0}, horizon={"type": int, "default": 1}, cost_bps={"type": float, "default": 0.0}, annualization_rows={"type": int}, signal_decay={"type": int, "default": 0},
        truncation={"type": float, "default": 0.0}, daily={"action": "store_true"}, proxy={"action": "store_true"},
    )]
    command("doctor", doctor)
    command("inspect", inspect, ("expression", {}), *catalog, *may(reduce_unit_scaling={"action": "store_true"}))
    command("dedup", dedup, *need("--input", "--output"), *catalog)
    command("search", search, *need("--output"), *run_options, *catalog, *may(archive={}, checkpoint={}, resume={}))
    command("benchmark", benchmark, *run_options)
    command("prioritize", prioritize, *need("--input", "--feedback", "--output"), *near)
    command("screen-feedback", screen_feedback, *need("--input", "--feedback"), ("--threshold", {"type": float, "required": True}), *may(output={}), *near)
    command("audit-feedback", audit_feedback, *need("--feedback"), *may(evaluation={}), *near)
    command("compile", compile_, ("expression", {}), *need("--dialect"), *catalog)
    command("evaluate", evaluate, ("expression", {}), *evaluation, *catalog)
    command("evaluate-batch", evaluate_batch, *need("--input", "--output"), *evaluation, *catalog)
    command("prepare-panel", prepare_panel, *need("--root", "--output", "--start", "--evaluation-start", "--train-end", "--validation-end", "--end"), ("--universe-size", {"type": int, "required": True}), *may(dataset_id={"default": "universe"}))
    command("session", session)
    args = parser.parse_args(argv)
    try:
        args.run(args)
    except (ValueError, OSError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
