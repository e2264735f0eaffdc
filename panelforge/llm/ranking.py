"""Problem 6: one ranking from several scores of different scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm._candidates import current_candidates
from panelforge.llm._positions import positions

SCORES = {"simplicity": 1.0, "archive_novelty": 1.0, "structural_novelty": 1.0, "transform_diversity": 1.0}

# Coefficients of Wichura's algorithm AS 241 (PPND16), from the published paper.
_A = [3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
_C = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_E = [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _poly(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def inverse_normal(p: Column) -> Column:
    """The normal quantile of a probability strictly between 0 and 1, within the JVM, to about 16 digits."""
    q = p - F.lit(0.5)
    centre = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    near, far = tail - F.lit(1.6), tail - F.lit(5.0)
    side = F.when(tail <= 5, _poly(_C, near) / _poly(_D, near)).otherwise(_poly(_E, far) / _poly(_F, far))
    return F.when(F.abs(q) <= 0.425, q * _poly(_A, centre) / _poly(_B, centre)).when(q < 0, -side).otherwise(side)


def percentile_scores(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """For each item and usable score: group, item, score_name, below, equal, usable (counts in its group), z.

    Values are first counted by (group, score, value), in part before the shuffle, so ties shrink. The distinct values
    are sorted over all partitions and their counts summed up to exact ranks, so that a group of any size is spread.
    The percentile with averaged ties is (below + equal / 2) / usable, which is never 0 or 1; z is its normal quantile.
    Null and NaN scores are left out; -0.0 counts as 0.0; infinities rank at the ends.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("value")) for s in scores)))
    long = df.select(F.col(group).alias("grp"), F.col(item).alias("item"), pairs.alias("p")).select("grp", "item", "p.score_name", (F.col("p.value") + F.lit(0.0)).alias("value"))
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = long.groupBy("grp", "score_name", "value").agg(F.count("*").alias("equal"))
    ranked = positions(counted, ["grp", "score_name"], [F.col("value").asc()], "upto", weight="equal")
    totals = ranked.groupBy("grp", "score_name").agg(F.sum("equal").alias("usable"))
    table = ranked.join(totals.withColumnRenamed("grp", "g2").withColumnRenamed("score_name", "s2"), F.col("grp").eqNullSafe(F.col("g2")) & (F.col("score_name") == F.col("s2")))
    table = table.select(F.col("grp").alias("g"), F.col("score_name").alias("s"), F.col("value").alias("v"), (F.col("upto") - F.col("equal")).alias("below"), "equal", "usable")
    joined = long.join(table, F.col("grp").eqNullSafe(F.col("g")) & (F.col("score_name") == F.col("s")) & (F.col("value") == F.col("v")))
    p = (F.col("below") + F.col("equal") / 2) / F.col("usable")
    return joined.select("grp", "item", "score_name", "below", "equal", "usable", inverse_normal(p).alias("z"))


def combined_scores(df: DataFrame, group: str, item: str, weights: dict[str, float]) -> DataFrame:
    """group, item, n_scores, combined (weighted mean of z over the usable scores) and ``top_of`` / ``usable_of`` maps.

    An item without a usable score has combined null and n_scores 0. ``above`` maps a score's name to the number of
    usable values strictly above the item's own, ``usable`` to their number. Weights must be positive.
    """
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("give at least one score, with positive weights")
    z = percentile_scores(df, group, item, list(weights))
    w = reduce(lambda acc, s: acc.when(F.col("score_name") == s, F.lit(float(weights[s]))), weights, F.when(F.lit(False), F.lit(0.0)))
    above = F.col("usable") - F.col("below") - F.col("equal")
    aggs = [F.count("*").alias("n_scores"), F.sum(w * F.col("z")).alias("wz"), F.sum(w).alias("w")]
    for s in weights:
        aggs += [F.max(F.when(F.col("score_name") == s, above)).alias(f"above_{s}"), F.max(F.when(F.col("score_name") == s, F.col("usable"))).alias(f"usable_{s}")]
    named = z.groupBy(F.col("grp").alias(group), F.col("item").alias(item)).agg(*aggs)
    return named.withColumn("combined", F.col("wz") / F.col("w")).drop("wz", "w")


def score_ranking(df: DataFrame, group: str, item: str, weights: dict[str, float]) -> DataFrame:
    """group, item, n_scores, combined, position: one order of all items of each group, best first.

    Order: combined descending (rounded to 9 digits, that sums added up in another order give the same), then item. Items
    without any usable score come last. ``item`` must be unique within its group. An empty table gives no rows.
    """
    scored = combined_scores(df, group, item, weights)
    none = df.select(group, item).filter(reduce(lambda a, b: a & b, ((F.col(s).isNull() | F.isnan(s)) for s in weights)))
    rows = scored.select(group, item, "n_scores", F.round("combined", 9).alias("combined")).unionByName(none.select(group, item, F.lit(0).cast("long").alias("n_scores"), F.lit(None).cast("double").alias("combined")))
    return positions(rows, [group], [F.col("combined").desc_nulls_last(), F.col(item).asc()], "position")


def component_table(candidates: DataFrame) -> DataFrame:
    """run_id, candidate_id and the four components of each current candidate (all null where the struct is)."""
    return current_candidates(candidates, {"run_id": F.col("run_id"), **{s: F.col(f"score_components.{s}") for s in SCORES}})


def leaders(candidates: DataFrame) -> DataFrame:
    """run_id, candidate_id of those with four usable scores, each among the top twentieth of its run.

    That is, 20 times the number strictly above is less than the number of usable values, for each score. Such a
    candidate's percentile is above 0.475 for each score (less than a twentieth is above; of the rest at most all are
    ties, half of which count), so its combined score is above the normal quantile of 0.475; the counts then decide.
    """
    scored = combined_scores(component_table(candidates), "run_id", "candidate_id", SCORES)
    high = F.col("combined") >= inverse_normal(F.lit(0.475)) - F.lit(1e-9)
    top = reduce(lambda a, b: a & b, (F.lit(20) * F.col(f"above_{s}") < F.col(f"usable_{s}") for s in SCORES))
    return scored.filter((F.col("n_scores") == len(SCORES)) & high).filter(top).select("run_id", "candidate_id")
