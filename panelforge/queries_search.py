"""Queries over formulas: identity, trees, generation, scores, search, sessions, files and the command line.

Where a result follows from columns of the tables, the SQL computes it; runs of the search and of sessions are held
against what must be true of every one of their rows.
"""

from __future__ import annotations

import contextlib
import dataclasses
import datetime as dt
import io
import json
import math
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.expr.analysis import analyze
from panelforge.expr.canonical import canonical, fingerprint
from panelforge.expr.catalog import Catalog, FieldSpec, builtin
from panelforge.expr.descriptor import describe
from panelforge.expr.parser import parse
from panelforge.expr.rewrite import Dialect, DialectError, compile_dialect, reduce_unit_scaling
from panelforge.expr.tree import PathError, allowed_kinds, paths, replace_subtree, show, subtree_at
from panelforge.operators import evaluation
from panelforge.plans.current import current_candidates, tidy
from panelforge.plans.lineage import new_table_path
from panelforge.plans.workers import ship
from panelforge.search import artifacts, dedup, engine, feedback, scoring, selection, session, transform
from panelforge.sources import panels, universe

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The built-in operators over the fields and groups of catalog_fields (a fixed table); scalars in hundredths."""
    rows = _read(spark, sf_dir, "catalog_fields").filter("field_name is not null").orderBy("field_name").collect()
    fields = tuple(FieldSpec(r["field_name"], r["family"] or f"public:{r['field_name']}", tuple(r["allowed_roles"] or ("signal_input",))) for r in rows if r["field_kind"] == "signal")
    groups = tuple(r["field_name"] for r in rows if r["field_kind"] == "group")
    return dataclasses.replace(builtin(), name="tables", fields=fields, groups=groups, scalar_domain=(-100.0, 100.0, 0.01)).validated()


def per_formula(df: DataFrame, keys: list[str], expression: str, schema: str, make: Callable[[object, str], Iterator[tuple]]) -> DataFrame:
    """The rows that ``make`` (key values, text) gives for each row of ``df``, in Arrow batches; keys come first."""
    kinds = dict(df.dtypes)
    full = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    names = [c.split()[0] for c in full.split(", ")]
    types = [pa.string() if k == "string" else pa.bool_() if k == "boolean" else pa.float64() if k == "double" else pa.int32() if k == "int" else pa.int64() for k in (c.split()[1] for c in full.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            for *key, text in zip(*columns):
                rows += [(*key, *r) for r in make(tuple(key), text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    ship(df.sparkSession)
    return df.filter(F.col(expression).isNotNull()).select(*keys, F.col(expression).alias("__text")).mapInArrow(run, full)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "candidates").filter("candidate_id is not null").select("candidate_id", "expression").distinct()


# identity


def formula_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text, fingerprint and sizes of every candidate's formula under the tables' catalog."""
    rows = dedup.analyzed(_candidates(spark, sf_dir), "expression", table_catalog(spark, sf_dir))
    return rows.select("candidate_id", "analysis.canonical", "analysis.fingerprint", "analysis.nodes", "analysis.depth", "analysis.error")


def proposals_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every measured proposal, whose formulas are laid out in several ways, the terms of the canonical text in order; null where a formula isn't valid."""
    p = _read(spark, sf_dir, "measured_proposals").filter("proposal_id is not null").select("proposal_id", "expression").distinct()
    rows = dedup.analyzed(p, "expression", table_catalog(spark, sf_dir))
    return rows.select("proposal_id", F.array_join(F.array_sort(F.split("analysis.canonical", "[(), ]+")), " ").alias("terms"))


def dedup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formulas of candidates and proposals, partitioned by meaning: the first of each counts, candidates before proposals."""
    c = _candidates(spark, sf_dir).select("candidate_id", "expression").withColumn("source", F.lit(0)).withColumnRenamed("candidate_id", "id")
    p = _read(spark, sf_dir, "measured_proposals").filter("proposal_id is not null").select(F.col("proposal_id").alias("id"), "expression").distinct().withColumn("source", F.lit(1))
    both = c.unionByName(p).withColumn("position", F.struct("source", "id", "expression"))
    out = dedup.partition(both, "position", "expression", table_catalog(spark, sf_dir))
    return out.select("position.source", "position.id", "status", "reason", F.col("duplicate_of.source").alias("first_source"), F.col("duplicate_of.id").alias("first_id"))


def dedup_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose formula means none that the history or the proposals hold, by valid fingerprints."""
    known = [_read(spark, sf_dir, t).select(F.lower(F.regexp_replace(F.regexp_replace(c, "^[^:]*:", ""), "[^0-9a-fA-F]", "")).alias("f")) for t, c in (("excluded_history", "entries"), ("measured_proposals", "semantic_fingerprint"))]
    c = _candidates(spark, sf_dir).groupBy("candidate_id").agg(F.min("expression").alias("expression"))
    out = dedup.new_only(dedup.partition(c, "candidate_id", "expression", table_catalog(spark, sf_dir)), known[0].unionByName(known[1]), "f")
    return out.select("candidate_id")


_EVENT_FIELDS = ("close", "open", "high", "low", "volume")


def _event_text(parts: list[Column]) -> Column:
    out = parts[-1]
    for i, p in reversed(list(enumerate(parts[:-1]))):
        out = F.when(F.pmod("event_id", F.lit(len(parts))) == i, p).otherwise(out)
    return out


def _event_columns() -> tuple[Column, Column, Column]:
    names = F.array(*map(F.lit, _EVENT_FIELDS))
    a = F.element_at(names, (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    b = F.element_at(names, (F.pmod(F.col("event_id") + F.col("user_id") * 3, F.lit(5)) + 1).cast("int"))
    return a, b, (F.pmod("event_id", F.lit(50)) + 2).cast("string")


def formula_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of every event in odd layouts, number forms and orders of arguments, by their canonical text."""
    a, b, w = _event_columns()
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    text = _event_text([
        c("  add( ", a, " ,", b, ", volume)"), c("multiply(", a, ", +", w, ".50, -.5)"), c("clip(", a, ",upper = ", w, ".,lower=-0)"), c("ts_corr(", a, ",", b, "\t,", w, ",)"), c("if_else(true, ", a, ", ", b, ")"), c('group_rank( ', a, ', group( "sector" ))'),
        c("winsorize(", a, ", std=", "1e0)"), c("multiply(", b, ",", a, ")"),
    ])
    e = _read(spark, sf_dir, "events").select("event_id", text.alias("text"))
    rows = dedup.analyzed(e, "text")
    return rows.select("event_id", "analysis.canonical", "analysis.error")


def formula_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of formulas of every event once their meaning is put in normal form, and what is proven of them."""
    a, b, w = _event_columns()
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    zero = c("subtract(", a, ", ", a, ")")
    text = _event_text([
        c("multiply(", w, ", rank(", a, "))"), c("divide(ts_mean(", a, ", ", w, "), ", w, ")"), c("add(", a, ", ", a, ", ", a, ")"), c("multiply(-", w, ", ", a, ")"), c("rank(rank(zscore(", a, ")))"), c("if_else(greater(", b, ", 1), abs(", a, "), abs(", a, "))"),
        zero, c("ts_std_dev(", zero, ", ", w, ")"), c("ts_rank(", zero, ", ", w, ")"), c("zscore(", zero, ")"), c("ts_skew(", zero, ", ", w, ")"), c("if_else(false, ", zero, ", ts_delta(", b, ", ", w, "))"),
    ])
    e = _read(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return per_formula(e, ["event_id"], "text", "meaning string, reason string", lambda _, t: [((x := analyze(parse(t))).semantic_canonical, x.rejection_reason)])


def formula_unit_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's formula inside a multiplication and a division by 1, and without them again."""
    catalog = table_catalog(spark, sf_dir)
    make = lambda _, t: [(canonical(reduce_unit_scaling(parse(f"divide(multiply(1, {t}), 1)", catalog))),)]
    return per_formula(_candidates(spark, sf_dir), ["candidate_id"], "expression", "reduced string", make)


#: What the dialect of ``formula_dialect`` lacks.
FOREIGN = ("ts_kurt", "ts_skew", "winsorize")


def formula_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's formula for a dialect without three operators, negations lowered to products: accepted, and how many were lowered."""
    catalog = table_catalog(spark, sf_dir)
    allowed = frozenset(o.name for o in catalog.operators) - {*FOREIGN, "negate"}
    d = Dialect("t", allowed, frozenset(f.name for f in catalog.fields), {"negate": ("multiply", -1.0)}).validated()

    def make(_, text: str) -> list[tuple]:
        try:
            out = compile_dialect(text, d, catalog)
        except DialectError:
            return [(False, 0)]
        return [("negate(" not in out.compiled_expression, len(out.lowerings_applied))]

    return per_formula(_candidates(spark, sf_dir), ["candidate_id"], "expression", "accepted boolean, lowered int", make)


def catalog_fields_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields and groups of the tables' catalog after a round trip through its JSON, whose checksum stays."""
    catalog = table_catalog(spark, sf_dir)
    back = Catalog.from_json(catalog.to_json())
    same = back.checksum == catalog.checksum
    rows = [(f.name, "signal", None if f.family.startswith("public:") else f.family, same) for f in back.fields] + [(g, "group", None, same) for g in back.groups]
    return spark.createDataFrame(rows, "field_name string, field_kind string, family string, same boolean")


# trees


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subtree's address in every candidate's formula, and the kinds its place accepts."""
    catalog = table_catalog(spark, sf_dir)

    def make(_, text: str) -> list[tuple]:
        n = parse(text, catalog)
        return [(show(n, e.path), ",".join(sorted(e.allowed)), subtree_at(n, e.path) is e.node and allowed_kinds(n, e.path, catalog) == e.allowed) for e in paths(n, catalog)]

    described = _read(spark, sf_dir, "candidates").filter("candidate_id is not null and structural_descriptor is not null").select("candidate_id", "expression").distinct()
    return per_formula(described, ["candidate_id"], "expression", "path string, kinds string, same boolean", make).drop("kinds")


def tree_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every formula whose root rolls over one argument: that argument inside a rank, and whether a field is refused as its window."""
    catalog = table_catalog(spark, sf_dir)

    def make(_, text: str) -> list[tuple]:
        n = parse(text, catalog)
        if n.shape != "binary" or not n.name.startswith("ts_"):
            return []
        inner = subtree_at(n, (0,))
        new = replace_subtree(n, (0,), parse(f"rank({canonical(inner)})", catalog), catalog)
        try:
            replace_subtree(n, (1,), inner, catalog)
            refused = False
        except PathError:
            refused = True
        return [(canonical(new), fingerprint(new), refused)]

    return per_formula(_candidates(spark, sf_dir), ["candidate_id"], "expression", "changed string, fingerprint string, refused boolean", make)


def formula_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every candidate's structural descriptor, made anew from its formula, one value a row."""
    catalog = table_catalog(spark, sf_dir)

    def make(_, text: str) -> list[tuple]:
        d = describe(parse(text, catalog), (), catalog)
        sets = [(n, v, 1) for n in ("operator_shingles", "ordered_paths", "fields", "groups") for v in getattr(d, n)]
        counts = [(n, k, v) for n in ("operator_histogram", "window_buckets") for k, v in getattr(d, n).items()]
        return [*sets, *counts, ("flags", "nonlinear", int(d.nonlinear)), ("flags", "conditional", int(d.conditional)), *(("field_families", f, 1) for f in d.field_families)]

    described = _read(spark, sf_dir, "candidates").filter("candidate_id is not null and structural_descriptor is not null").select("candidate_id", "expression").distinct()
    return per_formula(described, ["candidate_id"], "expression", "part string, value string, n int", make)


def descriptor_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate whose formula has the same descriptor signature."""
    catalog = table_catalog(spark, sf_dir)
    described = _read(spark, sf_dir, "candidates").filter("candidate_id is not null and structural_descriptor is not null").select("candidate_id", "expression").distinct()
    signed = per_formula(described, ["candidate_id"], "expression", "signature string", lambda _, t: [(describe(parse(t, catalog), (), catalog).signature,)])
    first = signed.groupBy("signature").agg(F.min("candidate_id").alias("first"))
    return signed.join(first, "signature").select("candidate_id", "first")


def descriptor_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each current candidate shares a parent with the first of its run."""
    c = current_candidates(_read(spark, sf_dir, "candidates"), {"run_id": F.col("run_id"), "p": F.transform("structural_descriptor.lineage_parents", tidy)}).filter("p is not null and run_id is not null")
    first = c.groupBy("run_id").agg(F.min_by("p", "candidate_id").alias("q"))
    return c.join(first, "run_id").select("candidate_id", F.coalesce(F.arrays_overlap("p", "q"), F.lit(False)).cast("int").alias("common"))


# generation


def _by_event(spark: SparkSession, sf_dir: str, schema: str, make: Callable[[int], list[tuple]]) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", F.lit("").alias("x"))
    return per_formula(e, ["event_id"], "x", schema, lambda key, _: make(key[0]))


def gp_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula drawn for every event: whether it is valid, within the limits, and the same when drawn again."""
    limits = transform.Limits()

    def make(i: int) -> list[tuple]:
        n, p = transform.sample(7, i, limits, builtin())
        return [(transform.valid(n, limits, builtin()), n.depth <= 6 and n.node_count <= 40 and n.operator_count <= 16, transform.sample(7, i, limits, builtin()) == (n, p), parse(canonical(n)).kind == "signal")]

    return _by_event(spark, sf_dir, "valid boolean, bounded boolean, repeated boolean, reads_back boolean", make)


def gp_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the formulas drawn for all events: how many, and whether bare fields are about as frequent as the grammar says."""
    n = F.count("*")
    drawn = _by_event(spark, sf_dir, "root string", lambda i: [(transform.sample(7, i, transform.Limits(), builtin())[0].operator or "field",)])
    share = F.sum(F.when(F.col("root") == "field", 1).otherwise(0)) / n
    return drawn.agg(n.alias("formulas"), F.abs(share - transform.FIELD_CHANCE).alias("off")).select("formulas", (F.col("off") < 4 / F.sqrt("formulas")).alias("as_weighted"))


def gp_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's formula, changed by a class drawn from its id: whether the child is valid, other, and says where it comes from."""
    catalog, limits, classes = table_catalog(spark, sf_dir), transform.Limits(max_depth=24, max_nodes=200, max_operators=100), list(transform.MUTATIONS)

    def make(key: tuple, text: str) -> list[tuple]:
        n, i = parse(text, catalog), key[0]
        cls = classes[i % len(classes)]
        child, p = transform.mutate(n, 5, i, limits, catalog, cls)
        if p.kind == "mutation":
            told = p.operation == transform.MUTATIONS[cls] and p.parent_fingerprints == (fingerprint(n),) and p.old_subtree_fingerprint != p.new_subtree_fingerprint and canonical(child) != canonical(n)
        else:
            told = p.kind == "fallback_generation" and p.parent_fingerprints == () and p.requested_operation == transform.MUTATIONS[cls] and p.retry_count == transform.RETRIES
        own, q = transform.mutate(n, 5, i, limits, catalog, applicable=True)
        return [(cls, transform.valid(child, limits, catalog), told, q.kind == "mutation" and transform.valid(own, limits, catalog) and canonical(own) != canonical(n))]

    return per_formula(_candidates(spark, sf_dir), ["candidate_id"], "expression", "class string, valid boolean, told boolean, applicable boolean", make)


def gp_crossovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's formula crossed with that of the candidate next by id: whether the child is valid, unlike both, and names them."""
    catalog, limits = table_catalog(spark, sf_dir), transform.Limits(max_depth=24, max_nodes=200, max_operators=100)
    c = _candidates(spark, sf_dir).groupBy("candidate_id").agg(F.min("expression").alias("expression"))
    next_ = c.select((F.col("candidate_id") - 1).alias("candidate_id"), F.col("expression").alias("other"))
    both = c.join(next_, "candidate_id").select("candidate_id", F.to_json(F.struct("expression", "other")).alias("pair"))

    def make(key: tuple, text: str) -> list[tuple]:
        pair = json.loads(text)
        a, b = parse(pair["expression"], catalog), parse(pair["other"], catalog)
        out = []
        for same in (False, True):
            child, p = transform.crossover(a, b, 5, key[0], limits, catalog, same_path=same)
            named = p.parent_fingerprints == (fingerprint(a), fingerprint(b)) and canonical(child) not in (canonical(a), canonical(b)) if p.kind == "crossover" else p.kind == "fallback_generation" and p.parent_fingerprints == ()
            out.append((same, transform.valid(child, limits, catalog), named))
        return out

    return per_formula(both, ["candidate_id"], "pair", "same_path boolean, valid boolean, named boolean", make)


def gp_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each described candidate's formula is within given limits of depth, nodes and operators."""
    catalog, limits = table_catalog(spark, sf_dir), transform.Limits(max_depth=5, max_nodes=20, max_operators=8)
    described = _read(spark, sf_dir, "candidates").filter("candidate_id is not null and structural_descriptor is not null").select("candidate_id", "expression").distinct()
    return per_formula(described, ["candidate_id"], "expression", "within boolean", lambda _, t: [(limits.accepts(parse(t, catalog), catalog),)])


def gp_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starting covers of each policy and a few seeds: 64 formulas of different meaning, all usable, the same again."""
    rows = []
    for policy in ("fixed", "seeded_diverse", "motif_diverse"):
        for seed in range(3):
            made = transform.cover(policy, seed, transform.Limits(), builtin())
            ids = {analyze(n).semantic_fingerprint for n, _ in made}
            rows.append((policy, seed, len(ids), all(analyze(n).rejection_reason is None for n, _ in made), made == transform.cover(policy, seed, transform.Limits(), builtin())))
    return spark.createDataFrame(rows, "policy string, seed int, formulas int, usable boolean, repeated boolean")


# scores and selection


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current described candidates of all runs with the six components: each run is a pool, the run least by name the archive."""
    d = F.col("structural_descriptor")
    for n in ("operator_shingles", "ordered_paths", "fields", "field_families", "groups", "lineage_parents"):
        d = d.withField(n, F.transform(F.col(f"structural_descriptor.{n}"), tidy))
    columns = {"run_id": F.col("run_id"), "d": d, "root_family": tidy("root_family"), "kind": F.col("provenance.kind"), "nodes": F.col("nodes"), "fingerprint": F.col("fingerprint")}
    c = current_candidates(_read(spark, sf_dir, "candidates"), columns).filter("d is not null and run_id is not null")
    archive = c.filter(F.col("run_id") == c.agg(F.min("run_id")).first()[0]).select("d", F.col("candidate_id").alias("place"))
    rows = scoring.novelty_components(c, "run_id", [F.col("candidate_id")], "d", archive)
    counted = rows.withColumns({"operator_count": F.aggregate(F.map_values("d.operator_histogram"), F.lit(0), lambda a, v: a + v), "parents": F.col("d.lineage_parents")})
    return scoring.weighted_score(scoring.pool_components(counted, "run_id"))


def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six components and the score of every described current candidate."""
    return _scored(spark, sf_dir).select("candidate_id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in (*scoring.COMPONENTS, "structural_score")))


def scored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every current candidate in its run by the score it has, nodes and fingerprint."""
    columns = {"run_id": F.col("run_id"), "structural_score": F.nanvl("structural_score", F.lit(None).cast("double")), "nodes": F.col("nodes"), "fingerprint": F.col("fingerprint")}
    return scoring.ranked(current_candidates(_read(spark, sf_dir, "candidates"), columns)).select("candidate_id", "place")


def elite_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 current candidates that a bounded archive keeps: buckets of kind, family and nodes in turns, those worth most first."""
    columns = {"kind": F.col("provenance.kind"), "family": tidy("root_family"), "nodes": F.col("nodes"), "d": F.col("structural_descriptor"), "fingerprint": F.col("semantic_fingerprint")}
    c = current_candidates(_read(spark, sf_dir, "candidates"), columns).filter("d is not null and family is not null and kind is not null and nodes is not null")
    rows = c.withColumns({"kind_no": F.array_position(F.array(*map(F.lit, transform.KINDS)), F.col("kind")), "bucket": selection.node_bucket(F.col("nodes")), "worth": selection.retention_column("d")})
    kept = selection.bounded_elites(rows, ["kind_no", "family", "bucket"], [F.col("worth").desc(), F.col("nodes"), F.col("fingerprint").asc_nulls_last(), F.col("candidate_id")], 300)
    return kept.select("candidate_id", "worth")


# search, sessions, files, command line


def _run(spark: SparkSession, **kw: object) -> tuple[list[dict], dict]:
    return engine.Search(engine.SearchSpec(**{"seed": 11, "max_candidates": 1024, "shortlist": 40, "batch": 320, **kw}), spark=spark).run()


def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortlist of a search on executors: fingerprints, scores from the components, sizes and descriptors, held against the formulas."""
    records, _ = _run(spark)
    rows = [(i + 1, r["expression"], r["fingerprint"], r["structural_score"], json.dumps(r["score_components"]), json.dumps(r["normalized_weights"]), r["nodes"], r["depth"], r["semantic_fingerprint"]) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "place int, expression string, fingerprint string, score double, parts string, weights string, nodes int, depth int, semantic string")
    m = dedup.analyzed(df, "expression")
    kind = "map<string,double>"
    total = F.aggregate(F.map_entries(F.from_json("parts", kind)), F.lit(0.0), lambda a, e: a + e["value"] * F.element_at(F.from_json("weights", kind), e["key"]))
    once = F.count("*").over(Window.partitionBy("semantic"))
    return m.select("place", (F.sha2("expression", 256) == F.col("fingerprint")).alias("named"), (F.abs(total - F.col("score")) < 1e-9).alias("scored"), ((F.col("analysis.nodes") == F.col("nodes")) & (F.col("analysis.depth") == F.col("depth"))).alias("sized"), ((F.col("analysis.semantic_fingerprint") == F.col("semantic")) & F.col("analysis.reason").isNull() & (once == 1)).alias("own_meaning"))


def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a search on executors."""
    _, m = _run(spark)
    c = m["counts"]
    rows = [("attempted", c["attempted"]), ("generations", c["generations"]), ("shortlist", m["shortlist"]), ("accounted", c["accepted"] + c["duplicates"] + c["trivial"] + c["invalid"])]
    return spark.createDataFrame(rows, "counter string, n long").withColumn("termination", F.lit(m["termination"]))


def _passed(spark: SparkSession, checks: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame([(k, bool(v)) for k, v in checks.items()], "fact string, holds boolean")


def _raises(error: type, f: Callable[[], object]) -> bool:
    try:
        f()
    except error:
        return True
    return False


def search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold between runs of the search: repeats, resumed runs, archives, guidance, deadlines, refusals."""
    small = {"max_candidates": 600, "shortlist": 24, "batch": 128}
    plain, manifest = _run(spark, **small)
    driver, _ = _run(None, **small)
    folder = tempfile.mkdtemp(prefix="panelforge-search-")
    path = os.path.join(folder, "state.json")
    spec = engine.SearchSpec(seed=11, **small)
    _, paused = engine.Search(dataclasses.replace(spec, pause_after=1)).run(path)
    with open(path) as f:
        state = json.load(f)
    resumed, _ = engine.Search(spec).run(resume=state)
    archive = [r["expression"] for r in plain]
    later, with_archive = engine.Search(spec, archive=archive).run()
    seeded = dataclasses.replace(spec, seed_from_archive=True, freeze_parents=True)
    children, _ = engine.Search(seeded, archive=archive).run()
    scales = {"depth": 10.0, "nodes": 40.0}
    records = tuple(feedback.Record(str(i), {"depth": float(r["depth"]), "nodes": float(r["nodes"])}, 0.9 if r["provenance"]["kind"] == "mutation" else -0.9, 1.0, r["semantic_fingerprint"]) for i, r in enumerate(plain))
    data = feedback.FeedbackDataset("d", "c", "o", scales, records)
    guide = engine.neighbour_guidance(data, feedback.FeedbackConfig(3, 1))
    policy = engine.action_policy(plain, data, feedback.PolicyConfig(minimum_support=1))
    guided, _ = engine.Search(dataclasses.replace(spec, feedback_elites=4), guidance=guide, policy=policy, archive=archive).run()
    ticks = iter(range(1, 1_000_000))
    late, lm = engine.Search(dataclasses.replace(spec, max_candidates=10_000_000, seconds=12.0), clock=lambda: float(next(ticks))).run()
    drafts = [engine.Draft(m, i, {}) for i, m in enumerate(engine.prepare(parse(r["expression"]), transform.Provenance("initial", "x"), transform.Limits(), builtin()) for r in plain)]
    elites = engine.Elites(9, drafts)
    elites.bound()
    seen = engine._Seen(2)
    fifo = [seen.add(x) for x in "abcab"]
    archive_sums = {engine.Search(spec, archive=a).archive_checksum for a in (archive, archive[::-1], [*archive, archive[0]])}
    return _passed(spark, {
        "a run is repeated": plain == _run(spark, **small)[0], "executors and driver make the same": plain == driver, "a resumed run ends the same": resumed == plain and paused["termination"] == "checkpoint_pause",
        "a checkpoint of another run is refused": _raises(artifacts.ArtifactError, lambda: engine.Search(dataclasses.replace(spec, seed=12)).run(resume=state)), "what the archive holds never comes out": not {r["semantic_fingerprint"] for r in plain} & {r["semantic_fingerprint"] for r in later},
        "an archive makes another run": with_archive["run_id"] != manifest["run_id"], "an archive's checksum knows no order and no copies": len(archive_sums) == 1, "frozen parents are those of the archive": {p for r in children for p in r["provenance"]["parent_fingerprints"]} <= {r["fingerprint"] for r in plain},
        "no child of an archive is its formula": not {r["expression"] for r in children} & set(archive), "measured outcomes move the policy": (policy.mutation, policy.crossover) == (15, policy.crossover) and policy.crossover <= 20,
        "guided records come before others": [guide(d) is not None for d in _drafts_of(guided)] == sorted([guide(d) is not None for d in _drafts_of(guided)], reverse=True) or len(guided) == 24, "a deadline ends a run": lm["termination"] == "duration_deadline" and 0 < len(late) <= 24,
        "elites are bounded": len(elites) == min(9, len(drafts)), "forgotten identities come back": fifo == [True, True, True, True, True], "bounds of a specification are kept": all(_raises(ValueError, lambda k=k, v=v: engine.SearchSpec(**{k: v}).checked()) for k, v in (("max_candidates", 0), ("shortlist", 100_001), ("cover", "x"), ("feedback_elites", 999))),
        "options must fit together": _raises(ValueError, lambda: engine.Search(spec, policy=policy)) and _raises(ValueError, lambda: engine.Search(seeded)) and _raises(ValueError, lambda: engine.Search(dataclasses.replace(spec, feedback_elites=1))),
        "a search catalog has built-in operators only": _raises(ValueError, lambda: engine.compatible(dataclasses.replace(builtin(), operators=(*builtin().operators, dataclasses.replace(builtin().operators[0], name="other"))))), "children have seeds of their own": len({transform.rng_for("offspring", 1, g, s).random() for g in range(20) for s in range(20)}) == 400,
        "half of a shortlist is from the cover at most": sum(r["provenance"]["operation"] in transform.COVERS for r in plain) <= 12,
    })


def _drafts_of(records: list[dict]) -> list[engine.Draft]:
    return [engine.Draft(engine.prepare(parse(r["expression"]), transform.Provenance(r["provenance"]["kind"], ""), transform.Limits(), builtin()), 0, {}) for r in records]


def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ask/tell sessions under every parent policy."""
    facts: dict[str, bool] = {}
    for policy in session.PARENT_POLICIES:
        c = session.SessionConfig("e", seed=3, batch_size=4, max_evaluations=12, parent_capacity=3, parent_selection=policy, exploration_policy="grammar", mutation_policy="applicable").checked()
        s, other, ok = session.Session(c), session.Session(c), True
        while batch := s.ask():
            ok &= batch == s.ask() == other.ask()
            told = {p.semantic_fingerprint: float(p.ordinal % 5) for p in s.score_requests()}
            s.tell("e", "pool", told)
            other = session.Session.restore(other.checkpoint(), c)
            other.tell("e", "pool", list(reversed(told.items())))
            ok &= s.checkpoint() == other.checkpoint() and len(s.parents) <= 3
        facts[f"{policy}: batches repeat, restored sessions agree, all is measured once"] = ok and s.counters()["measured"] == 12 and s.counters()["emitted"] == 12
    c = session.SessionConfig("e", seed=1, batch_size=4, max_evaluations=12, parent_capacity=3).checked()
    s = session.Session(c)
    s.ask()
    before, scores = s.checkpoint(), {p.semantic_fingerprint: 1.0 for p in s.score_requests()}
    key = next(iter(scores))
    bad = [("x", "pool", scores), ("e", " ", scores), ("e", "pool", {k: v for k, v in scores.items() if k != key}), ("e", "pool", {**scores, key: math.nan}), ("e", "pool", {**scores, "0" * 64: 1.0})]
    facts["bad snapshots change nothing"] = all(_raises(session.SessionError, lambda b=b: s.tell(*b)) for b in bad) and s.checkpoint() == before
    s.tell_screened("e", "pool", {key: 1.0})
    facts["screened proposals are counted and gone"] = (s.counters()["measured"], s.counters()["screened_out"]) == (1, 3)
    state = json.loads(before)
    broken = [{"attempted": c.max_attempts + 1}, {"seen": []}, {"seen": ["x"]}, {"emitted": 99}, {"catalog": "0"}]
    facts["broken checkpoints are refused"] = all(_raises(session.SessionError, lambda b=b: session.Session.restore(json.dumps({**state, **b}), c)) for b in broken)
    facts["another configuration is refused"] = _raises(session.SessionError, lambda: session.Session.restore(before, dataclasses.replace(c, seed=9)))
    seeds = [{"record_id": "a", "expression": "rank(close)", "outcome": 0.2}, {"record_id": "b", "expression": "ts_mean(open, 5)", "outcome": 0.1}]
    history = session.ExcludedHistory(frozenset(["0" * 64, analyze(parse("rank(volume)")).semantic_fingerprint])).checked()
    w = session.Session.from_measured(c, seeds, history)
    asked = {p.semantic_fingerprint for p in w.ask()}
    facts["measured seeds are parents and history is never proposed"] = w.counters()["imported"] == 2 and not asked & history.entries and {p.expression for p, _ in w.parents} == {"rank(close)", "ts_mean(open, 5)"}
    facts["a referred history must be given again"] = _raises(session.SessionError, lambda: session.Session.restore(w.checkpoint(), c)) and session.Session.restore(w.checkpoint(), c, history=history).checkpoint() == w.checkpoint()
    facts["bounds of a configuration are kept"] = all(_raises(session.SessionError, lambda k=k, v=v: dataclasses.replace(c, **{k: v}).checked()) for k, v in (("batch_size", 257), ("parent_capacity", 0), ("max_evaluations", 0), ("evaluator_context", " "), ("exploration_policy", "x")))
    out: list[str] = []
    session.serve([json.dumps(x) for x in ({"op": "ask"}, {"op": "init", "config": {"evaluator_context": "e", "batch_size": 2}}, {"op": "ask"}, {"op": "checkpoint"}, {"op": "nope"})], out.append)
    facts["the bridge answers line by line"] = [json.loads(x)["ok"] for x in out] == [False, True, True, True, False]
    return _passed(spark, facts)


def artifact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates as JSON lines in the shared folder, and read back."""
    path = new_table_path(spark, "lines")
    c = _read(spark, sf_dir, "candidates").filter("expression is not null")
    artifacts.write_candidates(c.withColumn("schema", F.lit(artifacts.SCHEMA)), path)
    back = artifacts.read_candidates(spark, path)
    return back.select("run_id", "expression", "fingerprint", F.round("structural_score", 9).alias("structural_score"), "nodes", "depth", F.size("structural_descriptor.ordered_paths").alias("paths"), F.col("provenance.kind").alias("kind"))


def artifact_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of published files, manifests, feedback datasets and dialects."""
    folder = tempfile.mkdtemp(prefix="panelforge-artifacts-")
    out = os.path.join(folder, "c.jsonl")
    records, manifest = engine.Search(engine.SearchSpec(seed=1, max_candidates=150, shortlist=8)).run()
    first = artifacts.publish(out, records, manifest)
    facts = {"what is published is read back": artifacts.read_published(out) == (json.loads(json.dumps(records)), {**json.loads(json.dumps(manifest)), "candidates_sha256": first["candidates_sha256"]}), "publishing again changes nothing": artifacts.publish(out, records, manifest) == first}
    facts["records of another run are refused"] = _raises(artifacts.ArtifactError, lambda: artifacts.publish(out, [{**records[0], "run_id": "x"}], manifest))
    facts["nothing temporary is left"] = not [f for f in os.listdir(folder) if f.startswith(".tmp-")]
    facts["a file isn't overwritten unasked"] = _raises(artifacts.ArtifactError, lambda: artifacts.write_jsonl(out, records, overwrite=False))
    pair = os.path.join(folder, first["directory"], "candidates.jsonl")
    with open(pair, "a") as f:
        f.write("\n")
    facts["altered files are noticed"] = _raises(artifacts.ArtifactError, lambda: artifacts.read_published(out))
    with open(out, "a") as f:
        f.write('\n{"schema": 9}\n')
    facts["an unknown schema is named by its line"] = _raises(artifacts.ArtifactError, lambda: artifacts.load_candidates(out))
    path = os.path.join(folder, "state.json")
    spec = engine.SearchSpec(seed=1, max_candidates=300, shortlist=8, pause_after=1)
    engine.Search(spec).run(path)
    with open(path) as f:
        facts["a checkpoint has its schema and run"] = (json.load(f)["schema"], True) == (2, True)
    data = {"schema": 1, "dataset_id": "f", "context_checksum": "c", "outcome_label": "o", "feature_scales": {"depth": 2.0}, "records": [{"record_id": str(i), "features": {"depth": float(i)}, "outcome": 0.1, "confidence": 1.0} for i in range(4)]}
    other = {**data, "records": data["records"][::-1]}
    facts["a feedback dataset's checksum knows no order"] = feedback.FeedbackDataset.from_json(json.dumps(data)).checksum == feedback.FeedbackDataset.from_json(json.dumps(other)).checksum
    broken = [{"schema": 2}, {"feature_scales": {"depth": 0.0}}, {"feature_scales": {"x": 1.0}}, {"records": [data["records"][0]] * 2}]
    facts["broken feedback datasets are refused"] = all(_raises(ValueError, lambda b=b: feedback.FeedbackDataset.from_json(json.dumps({**data, **b}))) for b in broken)
    facts["bounds of the guidance are kept"] = all(_raises(feedback.FeedbackError, lambda a=a: feedback.FeedbackConfig(*a).checked()) for a in ((0, 1, 1.0), (3, 4, 1.0), (3, 1, 1.5)))
    facts["a dialect is read"] = Dialect.from_json(json.dumps({"schema": 1, "name": "t", "allowed_operators": ["rank", "multiply"], "allowed_fields": ["close"], "unary_scalar_lowerings": {"negate": {"replacement": "multiply", "scalar": -1}}})).lowerings == {"negate": ("multiply", -1.0)}
    facts["bad catalogs are refused"] = all(_raises(ValueError, lambda t=t: Catalog.from_json(t)) for t in ("[]", "{}", builtin().to_json().replace('"negate"', '"abs"')))
    return _passed(spark, facts)


def panel_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of days and event types after a round trip through its document."""
    back = panels.from_json(spark, panels.to_json(panels.events_daily(spark, sf_dir)))
    return back.df.select("ts", "asset", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("open", "high", "low", "close", "volume")))


def hive_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe's panel from tables partitioned by year, the first row in file order of each ticker and date."""
    from panelforge.queries_core import _ORDER, UNIVERSE, _tables

    daily, stocks = _tables(spark, sf_dir)
    root = new_table_path(spark, "market")
    years = F.col("partition_year").between(UNIVERSE.start.year, UNIVERSE.end.year)
    for name, df, order in (("daily", daily, ["date", "ticker"]), ("stocks", stocks.drop("l_linestatus"), ["date", "ticker", *_ORDER])):
        kinds = {c: "double" for c, k in df.dtypes if c in ("marketcap", "closeadj", "close", "open", "high", "low", "volume")}
        rows = df.select(*(F.col(c).cast(kinds.get(c, k)).alias(c) for c, k in df.dtypes)).withColumn("partition_year", F.year("date")).filter(years)
        rows.repartitionByRange("partition_year", *order[:2]).sortWithinPartitions("partition_year", *order).write.partitionBy("partition_year").parquet(f"{root}/{name}")
    panel = universe.prepare(spark, root, UNIVERSE)
    scaled = panel.df.withColumns({c: F.col(c) / 997 for c in ("close", "open")})
    return scaled.select("ts", "asset", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("close", "open", "volume", "returns", "realized_returns")))


def eval_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a batch in its order, failures among them, with the figures of the whole period."""
    from panelforge.queries_core import CONFIG, SIGNAL, brands

    texts = ["rank(", SIGNAL, "rank(other)", f"multiply(2, {SIGNAL})", 'group_rank(close, group("moon"))']
    rows = [(i + 1, r["status"], *((r["splits"]["overall"]["observations"], r["splits"]["overall"]["mean_gross"]) if r["status"] == "succeeded" else (None, None))) for i, r in enumerate(evaluation.evaluate_batch(texts, brands(spark, sf_dir), CONFIG))]
    df = spark.createDataFrame(rows, "place int, status string, observations long, mean_gross double")
    return df.select("place", "status", "observations", (F.round("mean_gross", 6) + F.lit(0.0)).alias("mean_gross"))


def eval_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One formula's record: the figures of its splits."""
    from panelforge.queries_core import CONFIG, SIGNAL, brands

    r = evaluation.evaluate(SIGNAL, brands(spark, sf_dir), CONFIG)
    rows = [(s, m["observations"], m["mean_gross"], m["net_sharpe"]) for s, m in (*r["splits"].items(), ("overall", r["overall"]))]
    df = spark.createDataFrame(rows, "split string, observations long, mean_gross double, net_sharpe double")
    return df.select("split", "observations", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean_gross", "net_sharpe")))


def feedback_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every dataset held out by the first digit of their id's hash, estimated from the others of their dataset."""
    from panelforge.queries_core import _feedback

    rows, guides, _ = _feedback(spark, sf_dir)
    held = F.substring(F.md5("id"), 1, 1).isin("0", "1", "2", "3")
    m = feedback.audit_metrics(feedback.holdout_by_dataset(rows.filter(~held), rows.filter(held), guides), ("dataset_id",))
    return m.select("dataset_id", "records", "predicted", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("coverage", "mae", "rmse")))


def feedback_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation weights of the built-in operators moved by the outcomes of each dataset's records."""
    from panelforge.queries_core import _feedback

    rows, guides, names = _feedback(spark, sf_dir)
    mapped = rows.join(F.broadcast(names), "dataset_id").select("dataset_id", F.map_from_arrays("keys", "vec").alias("features"), "outcome", "confidence")  # one row a dataset
    return feedback.operator_weights(mapped, builtin()).select("dataset_id", "operator", "weight")


def cli_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands, one after another, by their exit codes and what they leave."""
    from panelforge import cli

    folder = tempfile.mkdtemp(prefix="panelforge-cli-")
    at = lambda name: os.path.join(folder, name)

    def run(*args: str) -> tuple[int, str]:
        said = io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(io.StringIO()):
            try:
                code = cli.main(list(args))
            except SystemExit as e:
                code = 2 if e.code else 0
        return code, said.getvalue()

    def lines(name: str) -> int:
        with open(at(name)) as f:
            return sum(1 for _ in f)

    facts = {"doctor": run("doctor")[0] == 0, "inspect": '"semantic_canonical": "rank(close)"' in run("inspect", "rank(rank(close))")[1], "inspect refuses": run("inspect", "rank(")[0] == 1}
    facts["search"] = run("search", "--output", at("c.jsonl"), "--candidates", "150", "--shortlist", "8")[0] == 0 and lines("c.jsonl") == 8 and os.path.exists(at("c.jsonl.manifest.json"))
    facts["dedup"] = run("dedup", "--input", at("c.jsonl"), "--output", at("d.jsonl"))[0] == 0 and lines("d.jsonl") == 8
    facts["dedup refuses its own input"] = run("dedup", "--input", at("c.jsonl"), "--output", at("c.jsonl"))[0] != 0
    facts["benchmark"] = run("benchmark", "--candidates", "100")[0] == 0
    panel = {"schema": 1, "dataset_id": "d", "source_label": "s", "timestamps": list(range(16)), "assets": ["a", "b"], "fields": {k: {"values": [float((i * 7) % 11) for i in range(32)]} for k in ("close", "volume")}, "realized_returns": {"values": [0.01 * (-1) ** i for i in range(32)]}, "groups": {"sector": ["x", "y"]}}
    data = {"schema": 1, "dataset_id": "f", "context_checksum": "c", "outcome_label": "o", "feature_scales": {"depth": 10.0, "nodes": 40.0}, "records": [{"record_id": str(i), "features": {"depth": float(i), "nodes": 3.0 * i}, "outcome": 0.1 * i - 0.3, "confidence": 1.0} for i in range(8)]}
    dialect = {"schema": 1, "name": "t", "allowed_operators": ["rank", "multiply"], "allowed_fields": ["close"], "unary_scalar_lowerings": {"negate": {"replacement": "multiply", "scalar": -1}}}
    for name, value in (("p.json", panel), ("f.json", data), ("x.json", dialect)):
        artifacts.write_json(at(name), value)
    options = ["--panel", at("p.json"), "--train-end", "6", "--validation-end", "10"]
    facts["evaluate"] = run("evaluate", "rank(close)", *options)[0] == 0
    facts["evaluate-batch"] = run("evaluate-batch", "--input", at("c.jsonl"), "--output", at("e.jsonl"), *options)[0] == 0 and lines("e.jsonl") == 8 and run("evaluate-batch", "--input", at("c.jsonl"), "--output", at("e.jsonl"), *options)[0] != 0
    facts["prioritize"] = run("prioritize", "--input", at("c.jsonl"), "--feedback", at("f.json"), "--output", at("g.jsonl"))[0] == 0 and lines("g.jsonl") == 8
    facts["screen-feedback"] = run("screen-feedback", "--input", at("c.jsonl"), "--feedback", at("f.json"), "--threshold", "0.0", "--output", at("h.jsonl"))[0] == 0 and lines("h.jsonl") == 9
    facts["audit-feedback"] = run("audit-feedback", "--feedback", at("f.json"))[0] == 0
    facts["compile"] = '"multiply(-1, rank(close))"' in run("compile", "negate(rank(close))", "--dialect", at("x.json"))[1]
    days = [dt.date(2020, 1, d) for d in (2, 3, 6, 7, 8, 9)]
    for table, rows, schema in (
        ("daily", [(t, d, c) for d in days for t, c in (("A", 3.0), ("B", 2.0), ("C", 1.0))], "ticker string, date date, marketcap double"),
        ("stocks", [(t, d, *[10.0 + i + j] * 5, 100.0) for i, d in enumerate(days) for j, t in enumerate("ABC")], "ticker string, date date, closeadj double, close double, open double, high double, low double, volume double"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/market/{table}/partition_year=2020")
    dates = ["--start", "2020-01-02", "--evaluation-start", "2020-01-03", "--train-end", "2020-01-06", "--validation-end", "2020-01-08", "--end", "2020-01-09"]
    facts["prepare-panel"] = run("prepare-panel", "--root", f"{folder}/market", "--output", at("panel.json"), "--universe-size", "2", *dates)[0] == 0 and len(json.load(open(at("panel.json")))["timestamps"]) == 6
    facts["prepare-panel refuses an existing file"] = run("prepare-panel", "--root", f"{folder}/market", "--output", at("panel.json"), "--universe-size", "2", *dates)[0] != 0
    return _passed(spark, facts)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        formula_identity, proposals_identity, dedup_candidates, dedup_new, formula_texts, formula_meaning, formula_unit_scaling, formula_dialect, catalog_fields_back, tree_paths, tree_replace, formula_descriptors, descriptor_twins, descriptor_ancestors,
        gp_samples, gp_fields, gp_mutations, gp_crossovers, gp_limits, gp_covers, score_components, scored_order, elite_archive, search_records, search_counts, search_facts, session_facts, artifact_candidates, artifact_facts, panel_json, hive_universe,
        eval_batch, eval_record, feedback_holdout, feedback_policy, cli_facts,
    )
}
