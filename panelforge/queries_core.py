"""Queries over the star-schema panels, one or more for each operator of the library."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.expr.descriptor import distance_column
from panelforge.expr.parser import parse
from panelforge.operators import evaluation
from panelforge.operators.panel import Panel
from panelforge.plans.compiler import compile_signals
from panelforge.plans.current import current_candidates, tidy
from panelforge.plans.numbering import placed_within
from panelforge.search import feedback, guidance
from panelforge.sources import panels, universe

Query = Callable[[SparkSession, str], DataFrame]

#: Scaled so that moments have few digits, by a prime so that no quotient ends on a half at the sixth place.
PRICE, VOLUME = "divide(close, 997)", "divide(volume, 100)"

OPERATORS = {
    "negate": f"negate({PRICE})", "abs": f"abs(ts_delta({PRICE}, 2))", "sign": "sign(ts_delta(close, 2))", "subtract": "divide(subtract(high, low), 997)", "divide": "divide(close, 997)",
    "add": f"add({PRICE}, divide(high, 997), divide(low, 997))", "multiply": f"multiply({PRICE}, 0.5, {VOLUME})", "clip": f"clip({PRICE}, lower=1.5, upper=2.5)",
    "greater": f"if_else(greater(ts_delta(close, 3), 10), {VOLUME}, {PRICE})", "if_else": f"if_else(greater({PRICE}, 2), divide(high, 997), divide(low, 997))", "if_else_true": f"if_else(true, {PRICE}, {VOLUME})", "if_else_false": f"if_else(false, {PRICE}, {VOLUME})",
    "rank": "rank(close)", "zscore": f"zscore({PRICE})", "winsorize": f"winsorize({PRICE}, std=1.2)", "group_rank": 'group_rank(close, group("sector"))',
    **{n: f"{n}({PRICE}, {w})" for n, w in {
        "ts_delay": 3, "ts_delta": 2, "ts_sum": 5, "ts_mean": 5, "ts_std_dev": 5, "ts_zscore": 5, "ts_var": 5, "ts_skew": 5, "ts_kurt": 5, "ts_min": 5, "ts_max": 5, "ts_median": 5, "ts_mad": 5, "ts_rank": 6, "ts_wma": 5, "ts_ema": 5,
    }.items()},
    "ts_cov": f"ts_cov({PRICE}, {VOLUME}, 10)", "ts_corr": f"ts_corr({PRICE}, {VOLUME}, 10)",
}

CONFIG = evaluation.EvaluationConfig(train_end=150, validation_end=250, evaluation_start=10, horizon=2, cost_bps=5.0, annualization_rows=52, proxy=True)
SIGNAL = f"rank(ts_delta({PRICE}, 2))"
UNIVERSE = universe.UniverseConfig(dt.date(1995, 1, 1), dt.date(2001, 12, 31), 5, "brands")


def six(c: str, name: str | None = None):
    """Rounded for comparison, without a negative zero."""
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(name or c)


def brands(spark: SparkSession, sf_dir: str) -> Panel:
    return panels.brand_weekly(spark, sf_dir)


def operator_query(formula: str, decay: int = 0) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_signals(brands(spark, sf_dir), {"x": parse(formula)}, decay).select("ts", "asset", six("x"))

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rank(ts_delta(close, 2)) over days and event types."""
    return compile_signals(panels.events_daily(spark, sf_dir), {"x": parse("rank(ts_delta(close, 2))")}).select("ts", "asset", six("x"))


def nested_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several formulas with shared subtrees and changes of axis, in one plan, over months and nations."""
    formulas = {"a": f"ts_mean(rank(ts_delta({PRICE}, 2)), 5)", "b": f"rank(ts_mean(rank(ts_delta({PRICE}, 2)), 5))", "c": f'group_rank(ts_delta({PRICE}, 2), group("sector"))'}
    df = compile_signals(panels.supply_monthly(spark, sf_dir), {k: parse(v) for k, v in formulas.items()})
    return df.select("ts", "asset", six("a"), six("b"), six("c"))


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_signals(brands(spark, sf_dir), {"x": parse(SIGNAL)})


def eval_future_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = brands(spark, sf_dir).df
    return df.select("ts", "asset", evaluation.future_return(F.col("realized_returns"), 2).alias("outcome")).select("ts", "asset", six("outcome"))


def eval_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.with_positions(_signal(spark, sf_dir), ["t"], "x").select("ts", "asset", six("position"))


def eval_positions_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.with_positions(_signal(spark, sf_dir), ["t"], "x", 0.06).select("ts", "asset", six("position"))


def _evidence(spark: SparkSession, sf_dir: str) -> evaluation.Evidence:
    return evaluation.evidence(brands(spark, sf_dir), {"x": parse(SIGNAL)}, CONFIG)


def eval_daily_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).daily.select("signal_timestamp", "target_timestamp", six("gross"), six("net"), six("turnover"))


METRICS = ["pearson", "mean_gross", "mean_net", "mean_turnover", "annual_gross", "annual_net", "gross_sharpe", "net_sharpe", "gross_drawdown", "net_drawdown"]


def eval_split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).metrics.select("split", "observations", *map(six, METRICS))


def eval_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).metrics.select("split", *map(six, ["proxy_returns", "proxy_drawdown", "proxy_margin", "proxy_fitness"]))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as a market: a brand's value of the day, and its prices by line with a made-up adjustment."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("ticker"))
    x = line.join(part, line.l_partkey == part.p_partkey).withColumn("date", F.to_date(F.date_trunc("week", "l_shipdate")))
    daily = x.select("ticker", "date", F.col("l_extendedprice").alias("marketcap"))
    price = F.try_divide("l_extendedprice", "l_quantity")
    stocks = x.select("ticker", "date", (price * (1 - F.col("l_discount"))).alias("closeadj"), price.alias("close"), (price * 1.01).alias("open"), (price * 1.02).alias("high"), (price * 0.98).alias("low"), F.col("l_quantity").alias("volume"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return daily, stocks


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def prep_universe_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.universe_members(_tables(spark, sf_dir)[0], UNIVERSE).select(F.col("date").cast("string").alias("date"), "ticker", six("marketcap"))


def prep_realized_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily, stocks = _tables(spark, sf_dir)
    panel = universe.panel_from_tables(daily, stocks, UNIVERSE, _ORDER)
    scaled = panel.df.withColumns({c: F.col(c) / 997 for c in ("close", "open")})
    return scaled.select("ts", "asset", six("close"), six("open"), six("volume"), six("returns"), six("realized_returns"))


def _feedback(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, feedback.Guides, DataFrame]:
    """The usable records of every dataset, the scales and config of each, and the names of its features."""
    read = spark.read.parquet(f"{sf_dir}/feedback_datasets.parquet").filter("dataset_id is not null").collect()  # one row a dataset
    keys = {d["dataset_id"]: sorted(d["feature_scales"]) for d in read}
    guides = {d["dataset_id"]: ([d["feature_scales"][k] for k in keys[d["dataset_id"]]], feedback.FeedbackConfig(d["neighbors"], d["minimum_neighbors"], d["maximum_distance"])) for d in read}
    names = spark.createDataFrame(list(keys.items()), "dataset_id string, keys array<string>")
    r = spark.read.parquet(f"{sf_dir}/feedback_records.parquet").join(F.broadcast(names), "dataset_id").dropDuplicates(["dataset_id", "record_id"])
    good = r.filter(F.col("outcome").between(-1, 1) & (F.col("confidence") > 0) & (F.col("confidence") <= 1) & (F.size("features") == F.size("keys")))
    vec = F.transform("keys", lambda k: F.try_element_at("features", k))
    rows = good.select("dataset_id", F.col("record_id").alias("id"), F.col("semantic_fingerprint").alias("fingerprint"), vec.alias("vec"), "outcome", "confidence").filter(_finite("vec"))
    return rows, guides, names


def _finite(vec: str):
    return F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def estimate_columns() -> list:
    """Rounded for comparison; distances are means of sixteenths and so may end on a half, which 1e-9 settles."""
    return [(F.round(F.col("mean_distance") + F.lit(1e-9), 6) + F.lit(0.0)).alias("mean_distance"), *map(six, ["weighted_outcome", "dispersion", "conservative_outcome"])]


def _left_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The records of every dataset, and the estimate of each from the others of its dataset."""
    rows, guides, _ = _feedback(spark, sf_dir)
    return rows, feedback.estimates_by_dataset(feedback.neighbours_by_dataset(rows.select("dataset_id", "id", "vec"), rows, guides, leave_one_out=True), guides)


def feedback_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left_out(spark, sf_dir)[1].select("dataset_id", "query", "neighbors", *estimate_columns())


def feedback_loo_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, guides, _ = _feedback(spark, sf_dir)
    m = feedback.audit_metrics(feedback.leave_one_out_by_dataset(rows, guides), ("dataset_id",))
    return m.select("dataset_id", "records", "predicted", *map(six, ["coverage", "mae", "rmse", "sign_accuracy", "balanced_accuracy"]))


def _guidable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Every current candidate with its features, null without a descriptor, and a number that rises in the order of score, fingerprint, id; and the features' names."""
    tidied = F.col("structural_descriptor")
    for n in ("operator_shingles", "fields", "field_families", "groups", "lineage_parents"):
        tidied = tidied.withField(n, F.transform(F.col(f"structural_descriptor.{n}"), tidy))
    c = spark.read.parquet(f"{sf_dir}/candidates.parquet").select("candidate_id", "written_at", "structural_score", "fingerprint", "semantic_fingerprint", "nodes", "depth", tidied.alias("d"), tidy("root_family").alias("family"))
    names, values = feedback.feature_values("d", "family", "nodes", "depth")
    # made before rows are moved, as features are smaller than descriptors
    mapped = c.withColumn("vec", F.when(F.col("d").isNotNull(), values))
    cur = current_candidates(mapped, {"print": F.col("semantic_fingerprint"), "score": F.nanvl("structural_score", F.lit(None).cast("double")), "vec": F.col("vec")})
    keys = [F.col("score").desc_nulls_last(), F.col("print").asc_nulls_first(), F.col("candidate_id").asc()]
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cur.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("ord", F.monotonically_increasing_id())
    return ranged.select("candidate_id", F.col("print").alias("fingerprint"), "ord", "vec"), names


def feedback_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All current candidates, guided by every dataset: the estimate, the place in the dataset's order of guidance from 0, and whether it passes the screen at 0."""
    rows, guides, names = _feedback(spark, sf_dir)
    keys = {r["dataset_id"]: r["keys"] for r in names.collect()}  # one row a dataset
    candidates, features = _guidable(spark, sf_dir)
    met, by_number = guidance.guided_by_all(candidates, features, rows, guides, keys)
    # outcomes in billionths, as sums added up in another order differ in the last digits; 0 - v, as -v would be a negative zero
    down = lambda c: F.coalesce(F.lit(0.0) - F.signum(c) * F.floor(F.abs(c) * 1e9 + 0.5), F.lit(0.0))
    order = {"no_outcome": F.col("conservative_outcome").isNull(), "conservative": down("conservative_outcome"), "weighted": down("weighted_outcome"), "ord": F.col("ord")}
    placed = feedback.screened(placed_within(met, "dataset", order, "place"), 0.0)
    name = F.element_at(F.array(*map(F.lit, by_number)), F.col("dataset") + 1) if by_number else F.lit(None).cast("string")
    return placed.select(name.alias("dataset_id"), "candidate_id", "place", "exact", F.col("neighbors").cast("long").alias("neighbors"), *estimate_columns(), "eligible")


def feedback_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well confidence alone ranks the signs of all outcomes; many ties."""
    r = spark.read.parquet(f"{sf_dir}/feedback_records.parquet").filter("outcome is not null and not isnan(outcome) and confidence is not null and not isnan(confidence)")
    return feedback.rank_auc(r, "confidence", "outcome").select(six("auc"))


def feedback_operator_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/feedback_records.parquet").filter("outcome between -1 and 1 and confidence > 0 and confidence <= 1")
    clean = r.withColumn("features", F.map_filter("features", lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (v < 100000)))
    return feedback.operator_outcomes(clean).select("operator", "support", six("centred"))


def feedback_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All structural features of all candidates with a descriptor, one row each."""
    c = spark.read.parquet(f"{sf_dir}/candidates.parquet").filter("structural_descriptor is not null")
    m = feedback.feature_map("structural_descriptor", "root_family", "nodes", "depth")
    return c.select("candidate_id", F.explode(m).alias("feature", "value"))


def feedback_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, est = _left_out(spark, sf_dir)
    return feedback.screened(rows.select("dataset_id", "id").join(est.withColumnRenamed("query", "id"), ["dataset_id", "id"], "left"), 0.0).select("dataset_id", "id", "eligible")


def descriptor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each candidate row to the first of its run, by id."""
    c = spark.read.parquet(f"{sf_dir}/candidates.parquet").filter("structural_descriptor is not null").dropDuplicates(["candidate_id"]).select("candidate_id", "run_id", "structural_descriptor")
    first = c.groupBy("run_id").agg(F.min_by("structural_descriptor", "candidate_id").alias("b"))
    return c.join(first, "run_id").select("candidate_id", distance_column("structural_descriptor", "b").alias("d")).select("candidate_id", six("d"))


def field_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.search.selection import field_diverse

    c = spark.read.parquet(f"{sf_dir}/candidates.parquet").dropDuplicates(["candidate_id"])
    names = F.array_join(F.array_sort(F.array_distinct(F.coalesce("structural_descriptor.fields", F.array().cast("array<string>")))), ",")
    return field_diverse(c.select("candidate_id", names.alias("fields")), ["candidate_id"], "fields", 200, 2).select("candidate_id", "status")


def transform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/candidates.parquet")
    return c.groupBy(F.col("provenance.kind").alias("kind")).agg(F.count("*").alias("n"))


def elite_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current candidates taken in turns from the buckets of kind, root family and node bucket."""
    from panelforge.search.selection import node_bucket, round_robin

    columns = {"structural_score": F.col("structural_score"), "kind": F.col("provenance.kind"), "root_family": tidy("root_family"), "nodes": F.col("nodes")}
    c = current_candidates(spark.read.parquet(f"{sf_dir}/candidates.parquet"), columns).filter("structural_score is not null and not isnan(structural_score) and root_family is not null")
    buckets = c.withColumn("node_bucket", node_bucket(F.col("nodes")))
    return round_robin(buckets, ["kind", "root_family", "node_bucket"], [F.col("structural_score").desc(), F.col("nodes").asc(), F.col("candidate_id").asc()], 50).select("candidate_id", "place")


def dedup_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up formulas of the built-in catalog, one per event, partitioned into accepted, duplicate and rejected."""
    from panelforge.search.dedup import partition

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    field = F.element_at(F.array(*map(F.lit, ["close", "open", "high", "low", "volume"])), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    window, other = (F.pmod("event_id", F.lit(7)) + 2).cast("string"), F.when(F.pmod("event_id", F.lit(11)) == 0, field).otherwise(F.lit("open"))
    text = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("ts_mean("), field, F.lit(", "), window, F.lit(")"))).when(F.pmod("event_id", F.lit(3)) == 1, F.concat(F.lit("add("), other, F.lit(", "), field, F.lit(")"))).otherwise(F.concat(F.lit("subtract("), other, F.lit(", "), field, F.lit(")")))
    return partition(e.select(F.col("event_id").alias("position"), text.alias("expression")), "position", "expression").select("position", "status", "reason", "duplicate_of")


QUERIES: dict[str, Query] = {
    "flagship": flagship, **{f"op_{n}": operator_query(f) for n, f in OPERATORS.items()}, "op_signal_decay": operator_query(PRICE, 5), "op_nested_batch": nested_batch,
    **{f.__name__: f for f in (
        eval_future_return, eval_positions, eval_positions_truncated, eval_daily_pnl, eval_split_metrics, eval_proxy, prep_universe_topn, prep_realized_returns, feedback_knn, feedback_loo_audit, feedback_auc,
        feedback_operator_outcomes, feedback_features, feedback_screen, feedback_guided, descriptor_distance, field_diversity, transform_counts, elite_round_robin, dedup_partition,
    )},
}

