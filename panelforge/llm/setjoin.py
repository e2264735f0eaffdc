"""Problem 2: all pairs of records whose sets of values overlap above a similarity threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm._candidates import current_candidates
from panelforge.llm._prefixes import LIST_ROWS, key_rows, possible, rarity_counts, verified, with_prefixes
from panelforge.plans.lineage import cut


def value_tokens(values: Column | str) -> Column:
    """The distinct values of an array<string>, trimmed and lower-cased, nulls left out, as sorted 64-bit hashes.

    Only the two sets of one pair must be free of collisions, whose chance is below 1e-15 for sets of a hundred values.
    """
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.sort_array(F.array_distinct(F.transform(kept, lambda v: F.xxhash64(F.lower(F.regexp_replace(v, r"^\s+|\s+$", ""))))))


def set_classes(df: DataFrame, item: str, tokens: str) -> DataFrame:
    """item, k1, k2, n, tokens of each row with a non-empty set; (k1, k2) is the same for equal sets."""
    rows = df.select(F.col(item).alias("item"), F.col(tokens).alias("tokens")).filter(F.col("item").isNotNull() & (F.size("tokens") > 0))
    return rows.select("item", F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(7), F.reverse("tokens")).alias("k2"), F.size("tokens").alias("n"), "tokens")


def similar_classes(members: DataFrame, threshold: float, list_rows: int = LIST_ROWS) -> DataFrame:
    """a1, a2, b1, b2, similarity: pairs of different classes of ``members`` that are similar.

    Prefix-filtered join: one row stands for all equal sets; tokens are ordered by rarity over all rows; only the
    prefixes that the threshold asks for are indexed, as narrow rows; length, positional and bit filters are part of the
    join's own condition, so few pairs leave it, and only those are held against each other token by token. Lists of
    frequent tokens are split over salts, ``list_rows`` rows in each.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    classes = members.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    indexed = cut(with_prefixes(classes, "tokens", rarity_counts(members, "tokens"), threshold, list_rows))
    keys = key_rows(indexed)
    left = keys.withColumn("salt", F.pmod("k1", F.col("salts")).cast("int")).drop("salts").alias("a")
    right = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").alias("b")
    once = (F.col("a.k1") < F.col("b.k1")) | ((F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") < F.col("b.k2")))
    met = left.join(right, (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt")) & once & possible(threshold))
    pairs = met.select(F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2")).dropDuplicates()
    return verified(pairs, indexed.select("k1", "k2", "n", "tokens"), threshold)


def similar_pairs(df: DataFrame, item: str, tokens: str, threshold: float, list_rows: int = LIST_ROWS) -> DataFrame:
    """item_a < item_b, similarity: every pair of items whose sets have Jaccard of at least ``threshold``.

    ``df[tokens]`` are the hashes of ``value_tokens``; repeated rows of one item add nothing; null items, null and empty
    sets take no part.
    Items with equal sets are pairs of similarity 1. An empty table gives no rows. Use ``similar_classes`` where huge
    groups of equal sets should stay one row each.
    """
    members = cut(set_classes(df, item, tokens))
    narrow = members.select("item", "k1", "k2")
    pairs = similar_classes(members, threshold, list_rows)
    many = narrow.groupBy("k1", "k2").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
    own = many.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.lit(1.0).alias("similarity"))
    links = own.unionByName(pairs)
    a = narrow.select(F.col("item").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    b = narrow.select(F.col("item").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    same = (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))
    wide = links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).filter(F.when(same, F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    out = wide.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "similarity")
    return out.dropDuplicates(["item_a", "item_b"])


def class_links(df: DataFrame, item: str, tokens: str, threshold: float) -> DataFrame:
    """item, class_id (smallest item with an equal set), n_equal, n_links (items of other classes it is similar to).

    One row for each item with a non-empty set; copies are counted, not expanded into pairs.
    """
    members = cut(set_classes(df, item, tokens).dropDuplicates(["item", "k1", "k2"]))
    sizes = members.groupBy("k1", "k2").agg(F.min("item").alias("class_id"), F.count("*").alias("n_equal"))
    pairs = cut(similar_classes(members, threshold))
    ends = pairs.select("a1", "a2", "b1", "b2").unionByName(pairs.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    other = sizes.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("n_equal").alias("m"))
    links = ends.join(other, ["b1", "b2"]).groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("m").alias("n_links"))
    per_class = sizes.join(links, ["k1", "k2"], "left")
    rows = members.select("item", "k1", "k2").join(per_class, ["k1", "k2"])
    return rows.select(F.col("item").alias(item), "class_id", "n_equal", F.coalesce("n_links", F.lit(0)).alias("n_links"))


THRESHOLD = 0.85


def descriptor_sets(candidates: DataFrame) -> DataFrame:
    """candidate_id and ``tokens``: operator_shingles, ordered_paths and fields of its current row together.

    Values are hashed before the shuffle that finds the current rows, so no texts are moved.
    """
    d = "structural_descriptor"
    parts = F.concat(*(F.coalesce(F.col(f"{d}.{c}"), F.array().cast("array<string>")) for c in ("operator_shingles", "ordered_paths", "fields")))
    return current_candidates(candidates, {"tokens": value_tokens(parts)})


def similar_candidates(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """candidate_a < candidate_b, similarity."""
    pairs = similar_pairs(descriptor_sets(candidates), "candidate_id", "tokens", threshold)
    return pairs.select(F.col("item_a").alias("candidate_a"), F.col("item_b").alias("candidate_b"), "similarity")
