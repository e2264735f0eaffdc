"""Queries of the listed problems and the SQL they are held against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import encode, knn, linkage, packing, ranking, setjoin, splitting, subset, topn
from panelforge.llm._candidates import read


def _linked(spark: SparkSession, sf_dir: str) -> tuple[linkage.LinkIndex, DataFrame]:
    index, pairs = linkage.link_history(read(spark, sf_dir, "excluded_history"), read(spark, sf_dir, "measured_proposals"))
    return index, index.scored(pairs).withColumnRenamed("later_id", "proposal_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the operator that are certain by the listed rule, as all are at its threshold; weights only order them."""
    return _linked(spark, sf_dir)[1].filter("certain").select("earlier_id", "proposal_id")


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[1].select("earlier_id", "proposal_id", "fingerprint", "terms", "root", F.round("similarity", 6).alias("similarity"))


def p1_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned weight of each pattern of levels that occurs, and how many pairs have it."""
    pairs = _linked(spark, sf_dir)[1]
    return pairs.groupBy("fingerprint", "terms", "root").agg(F.count("*").alias("pairs"), F.round(F.max("weight"), 6).alias("weight"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, pairs = linkage.link_history(read(spark, sf_dir, "excluded_history"), read(spark, sf_dir, "measured_proposals"))
    return linkage.membership(index, pairs)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.nearest_records(knn.usable_vectors(read(spark, sf_dir, "feedback_records"), read(spark, sf_dir, "feedback_datasets")))
    return near.select(F.least("query", "neighbor").alias("record_a"), F.greatest("query", "neighbor").alias("record_b")).distinct()


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.nearest_records(knn.usable_vectors(read(spark, sf_dir, "feedback_records"), read(spark, sf_dir, "feedback_datasets")))
    return near.select(F.col("part").alias("dataset_id"), F.col("query").alias("record_id"), F.col("neighbor").alias("neighbor_id"), F.round("distance", 6).alias("distance"), "place")


def p4_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.diverse_subsets(read(spark, sf_dir, "candidates"), read(spark, sf_dir, "selection_requests"))


def p4_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every candidate in every pool it is in, by its place among the centres."""
    return subset.Subsets(read(spark, sf_dir, "candidates"), read(spark, sf_dir, "selection_requests")).assignments()


def p4_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each request: the pool, its candidates that have a cluster, the chosen, those of them in the pool and different, and whether every quota is within 1 of its share."""
    s = subset.Subsets(read(spark, sf_dir, "candidates"), read(spark, sf_dir, "selection_requests"))
    if not s.asked:
        return spark.createDataFrame([], "request_id int, pool_size long, assigned long, chosen long, different long, from_pool long, fair boolean")
    fair = []
    for r, own in s.quotas().items():
        rows, kinds = ({c: v[i] for c, v in s.sizes[r].items()} for i in (0, 1))
        due = subset.shares(rows, kinds, sum(own.values()))
        fair.append((r, all(abs(own[c] - due[c]) < 1 for c in own)))
    asked = F.explode(F.array(*(F.struct(F.lit(r).alias("request_id"), F.lit(f).cast("string").alias("family")) for r, f, _ in s.asked)))  # the stated requests
    pool = s.rows.select("candidate_id", F.col("family").alias("own"), asked.alias("r")).filter(F.col("r.family").isNull() | (F.col("r.family") == F.col("own"))).select("candidate_id", "r.request_id")
    sizes = pool.groupBy("request_id").agg(F.count("*").alias("pool_size"))
    placed = s.assignments().groupBy("request_id").agg(F.count("*").alias("assigned"))
    picked = s.chosen().join(pool.select("request_id", "candidate_id", F.lit(1).alias("inside")), ["request_id", "candidate_id"], "left")
    chosen = picked.groupBy("request_id").agg(F.count("*").alias("chosen"), F.count_distinct("candidate_id").alias("different"), F.count("inside").alias("from_pool"))
    return sizes.join(placed, "request_id").join(chosen, "request_id").join(spark.createDataFrame(fair, "request_id int, fair boolean"), "request_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_candidates(read(spark, sf_dir, "candidates")).select("run_id", "root_family", "candidate_id")


def p5_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = topn.top_candidates(read(spark, sf_dir, "candidates"))
    return top.select("run_id", "root_family", "candidate_id", F.round("structural_score", 6).alias("structural_score"), "position")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.leaders(read(spark, sf_dir, "candidates"))


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score_ranking(ranking.component_table(read(spark, sf_dir, "candidates")), "run_id", "candidate_id", ranking.SCORES).select("run_id", "candidate_id", "n_scores", F.round("combined", 6).alias("combined"), "position")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_candidates(read(spark, sf_dir, "candidates")).select("candidate_a", "candidate_b")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.class_links(setjoin.descriptor_sets(read(spark, sf_dir, "candidates")), "candidate_id", "tokens", setjoin.THRESHOLD)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(read(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "token_budgets"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "token_budgets"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each document's text, got back from its ids, and whether it has none."""
    ids = encode.encode_texts(read(spark, sf_dir, "documents"), "doc_id", "text")
    back = encode.decode_ids(ids.withColumn("key", F.struct("doc_id", (F.size("ids") == 0).alias("empty"))), "key", "ids")
    return back.select("key.doc_id", "key.empty", F.sha2("text", 256).alias("sha"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document and budget: whether its pieces have all its tokens, are numbered from 1, and are more than one only where it exceeds a container."""
    docs, budgets = read(spark, sf_dir, "documents"), read(spark, sf_dir, "token_budgets")
    got = packing.pack_documents(docs, budgets).groupBy("budget_id", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.min("piece_no").alias("first"))
    sized = encode.count_tokens(docs, "doc_id", "text").join(got, "doc_id").join(F.broadcast(budgets.select("budget_id", "max_tokens")), "budget_id")  # 6 rows at any scale
    whole = F.greatest(F.ceil(F.col("n_tokens") / F.col("max_tokens")), F.lit(1))
    return sized.select("budget_id", "doc_id", (F.col("packed") == F.col("n_tokens")).alias("complete"), ((F.col("first") == 1) & (F.col("last") == F.col("pieces"))).alias("numbered"), (F.col("pieces") == whole).alias("whole"))


def p9_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each budget: containers above their capacity, whether they are numbered without a gap, and whether they are within 1 % (and one) of the fewest possible."""
    docs, budgets = read(spark, sf_dir, "documents"), read(spark, sf_dir, "token_budgets")
    loads = packing.pack_documents(docs, budgets).groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("load"))
    sized = loads.join(F.broadcast(budgets.select("budget_id", "max_tokens")), "budget_id")  # 6 rows at any scale
    per = sized.groupBy("budget_id").agg(F.count(F.when(F.col("load") > F.col("max_tokens"), 1)).alias("over"), F.count("*").alias("n"), F.max("container_id").alias("last"), F.sum("load").alias("total"), F.max("max_tokens").alias("capacity"))
    return per.select("budget_id", "over", (F.col("n") == F.col("last")).alias("gapless"), (F.col("n") <= F.ceil(F.col("total") / F.col("capacity")) * 1.01 + 1).alias("tight"))


def p10_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document and budget: the hash of its text put together from its pieces without their overlaps (or of itself where it wasn't split), whether all fit, and whether each repeats enough of the one before.

    Pieces are put together where they were cut, in their order, so only hashes are moved.
    """
    docs, budgets = read(spark, sf_dir, "documents"), read(spark, sf_dir, "token_budgets").filter("lower(purpose) = 'split'")
    asked = {r["budget_id"]: (r["max_tokens"], r["overlap_tokens"] or 0) for r in budgets.collect()}  # 6 rows at any scale

    def run(batches):
        held = None  # budget, document, hash, characters, tokens so far, fits, enough
        for batch in batches:
            done = []
            for budget, doc, no, start, end, n, overlap, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if no == 1:
                    done += [held] if held else []
                    held = [budget, doc, hashlib.sha256(), 0, 0, True, overlap == 0]
                held[2].update(piece[held[3] - start :].encode())
                held[5] &= n <= asked[budget][0]
                held[6] &= no == 1 or overlap >= min(asked[budget][1], held[4])
                held[3], held[4] = end, held[4] + n - overlap
            yield _put(done)
        yield _put([held] if held else [])

    def _put(rows):
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        values = [(r[0], r[1], r[2].hexdigest(), r[5], r[6]) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)], names=["budget_id", "doc_id", "put", "fits", "enough"])

    pieces = splitting.split_documents(docs, budgets).select("budget_id", "doc_id", "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens", "piece")
    joined = pieces.mapInArrow(run, "budget_id int, doc_id long, put string, fits boolean, enough boolean")
    every = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("own"), F.explode(F.array(*map(F.lit, asked)).cast("array<int>")).alias("budget_id"))
    yes = F.lit(True)
    return every.join(joined, ["budget_id", "doc_id"], "left").select("budget_id", "doc_id", F.coalesce("put", "own").alias("sha"), F.coalesce("fits", yes).alias("fits"), F.coalesce("enough", yes).alias("overlapping"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_links, p1_weighted, p1_clusters, p3_found, p3_neighbors, p4_subsets, p4_assignments, p4_quotas, p2_found, p2_classes, p5_found, p5_positions, p6_found, p6_ranking, p8_ids, p8_roundtrip, p9_containers, p9_items, p9_loads, p10_pieces, p10_cover]
    return {f.__name__: f for f in named}


_CURRENT = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id
  ORDER BY written_at DESC NULLS LAST, structural_score DESC NULLS LAST, fingerprint DESC NULLS LAST) AS rn
  FROM candidates WHERE candidate_id IS NOT NULL) WHERE rn = 1)"""

_P5 = f"""WITH {_CURRENT}, usable AS (SELECT run_id, lower(regexp_replace(root_family, '^\\s+|\\s+$', '', 'g')) AS root_family,
  candidate_id, structural_score, nodes, fingerprint FROM cur WHERE root_family IS NOT NULL AND structural_score IS NOT NULL
  AND NOT isnan(structural_score)), placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, root_family
  ORDER BY structural_score DESC, nodes ASC NULLS LAST, fingerprint ASC NULLS LAST, candidate_id) AS position FROM usable)"""

_COMPONENTS = ["simplicity", "archive_novelty", "structural_novelty", "transform_diversity"]

_P6_LONG = f"""WITH {_CURRENT}, long AS (""" + " UNION ALL ".join(f"SELECT run_id, candidate_id, '{c}' AS s, score_components.{c} AS v FROM cur WHERE score_components.{c} IS NOT NULL AND NOT isnan(score_components.{c})" for c in _COMPONENTS) + """),
  placed AS (SELECT *, count(*) OVER (PARTITION BY run_id, s) AS usable, rank() OVER (PARTITION BY run_id, s ORDER BY v DESC) - 1 AS above FROM long)"""

_P2 = f"""WITH {_CURRENT}, vals AS (SELECT DISTINCT candidate_id, lower(trim(v)) AS v FROM (
  SELECT candidate_id, unnest(list_concat(list_concat(coalesce(structural_descriptor.operator_shingles, []), coalesce(structural_descriptor.ordered_paths, [])),
  coalesce(structural_descriptor.fields, []))) AS v FROM cur) WHERE v IS NOT NULL),
  sizes AS (SELECT candidate_id, count(*) AS n FROM vals GROUP BY 1),
  df AS (SELECT v, count(*) AS c FROM vals GROUP BY 1),
  ranked AS (SELECT vals.candidate_id, v, n, row_number() OVER (PARTITION BY vals.candidate_id ORDER BY c, v) AS k FROM vals JOIN df USING (v) JOIN sizes USING (candidate_id)),
  pre AS (SELECT * FROM ranked WHERE k <= n - ceil(0.85 * n - 1e-9) + 1),
  pairs AS (SELECT DISTINCT a.candidate_id AS x, b.candidate_id AS y, a.n AS nx, b.n AS ny FROM pre a JOIN pre b ON a.v = b.v AND a.candidate_id < b.candidate_id
    WHERE least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9),
  over AS (SELECT x, y, nx, ny, count(*) AS o FROM pairs JOIN vals a ON a.candidate_id = x JOIN vals b ON b.candidate_id = y AND a.v = b.v GROUP BY 1, 2, 3, 4)"""


def oracle_sql() -> dict[str, str]:
    return {
        **_more_sql(),
        "p4_quotas": f"""WITH {_CURRENT}, fam AS (SELECT candidate_id, lower(regexp_replace(root_family, '^\\s+|\\s+$', '', 'g')) AS own FROM cur),
  pool AS (SELECT request_id, subset_size, count(*) AS n FROM fam JOIN selection_requests r ON r.root_family IS NULL OR lower(regexp_replace(r.root_family, '^\\s+|\\s+$', '', 'g')) = own WHERE subset_size > 0 GROUP BY 1, 2)
  SELECT request_id, n AS pool_size, n AS assigned, least(n, subset_size) AS chosen, least(n, subset_size) AS different, least(n, subset_size) AS from_pool, true AS fair FROM pool""",
        "p5_found": f"{_P5} SELECT run_id, root_family, candidate_id FROM placed WHERE position <= 3",
        "p5_positions": f"{_P5} SELECT run_id, root_family, candidate_id, round(structural_score, 6) AS structural_score, position FROM placed WHERE position <= 3",
        "p6_found": f"{_P6_LONG} SELECT run_id, candidate_id FROM placed WHERE 20 * above < usable GROUP BY 1, 2 HAVING count(*) = 4",
        "p2_found": f"{_P2} SELECT x AS candidate_a, y AS candidate_b FROM over WHERE o >= 0.85 * (nx + ny - o) - 1e-9",
    }


_P1 = """WITH src AS (SELECT DISTINCT entry_id AS id, entries AS f, expression AS e, false AS proposal FROM excluded_history WHERE entry_id IS NOT NULL
  UNION ALL SELECT DISTINCT proposal_id, semantic_fingerprint, expression, true FROM measured_proposals WHERE proposal_id IS NOT NULL),
  keyed AS (SELECT id, proposal, lower(regexp_replace(regexp_replace(f, '^[^:]*:', ''), '[^0-9a-fA-F]', '', 'g')) AS fp,
    regexp_extract_all(lower(coalesce(e, '')), '[\\p{L}\\p{N}_.]+') AS t FROM src),
  grams AS (SELECT DISTINCT id, proposal, unnest(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM keyed),
  sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY 1),
  over AS (SELECT a.id AS x, b.id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id AND b.proposal GROUP BY 1, 2),
  linked AS (SELECT x, y FROM over JOIN sizes s ON s.id = x JOIN sizes r ON r.id = y WHERE o >= 0.6 * (s.n + r.n - o) - 1e-9
    UNION SELECT a.id, b.id FROM keyed a JOIN keyed b ON a.fp = b.fp AND length(a.fp) = 64 AND a.id < b.id AND b.proposal)"""

_P3 = """WITH scale AS (SELECT dataset_id, neighbors, e.key AS k, e.value AS s FROM (SELECT dataset_id, neighbors, unnest(map_entries(feature_scales)) AS e FROM feedback_datasets)),
  kv AS (SELECT dataset_id, record_id, e.key AS k, e.value AS v FROM (SELECT dataset_id, record_id, unnest(map_entries(features)) AS e FROM (SELECT DISTINCT dataset_id, record_id, features FROM feedback_records))),
  usable AS (SELECT r.dataset_id, r.record_id FROM kv r LEFT JOIN scale s ON r.dataset_id = s.dataset_id AND r.k = s.k GROUP BY 1, 2
    HAVING count(*) = (SELECT count(*) FROM scale c WHERE c.dataset_id = r.dataset_id) AND count(s.k) = count(*) AND count(v) = count(*) AND bool_and(isfinite(v))),
  num AS (SELECT kv.* FROM kv JOIN usable USING (dataset_id, record_id)),
  dist AS (SELECT a.dataset_id, a.record_id AS a, b.record_id AS b, any_value(s.neighbors) AS k, avg(least(abs(a.v - b.v) / s.s, 1)) AS d FROM num a JOIN num b ON a.dataset_id = b.dataset_id AND a.k = b.k AND a.record_id <> b.record_id
    JOIN scale s ON s.dataset_id = a.dataset_id AND s.k = a.k GROUP BY 1, 2, 3),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, a ORDER BY d, b) AS place FROM dist) WHERE place <= k)"""


def _quantile_sql(p: str) -> str:
    """The same rational functions as ``ranking.inverse_normal``."""

    def poly(coefficients: list[float], x: str) -> str:
        out = repr(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
        return out

    q, tail = f"({p} - 0.5)", f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    centre = f"(0.180625 - {q} * {q})"
    near = f"{poly(ranking._C, f'({tail} - 1.6)')} / {poly(ranking._D, f'({tail} - 1.6)')}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {poly(ranking._A, centre)} / {poly(ranking._B, centre)} WHEN {q} < 0 THEN -({near}) ELSE {near} END"


def _more_sql() -> dict[str, str]:
    ranked = f"""{_P6_LONG}, pct AS (SELECT run_id, candidate_id, (rank() OVER (PARTITION BY run_id, s ORDER BY v) - 1 + count(*) OVER (PARTITION BY run_id, s, v) / 2.0) / usable AS p FROM placed),
  z AS (SELECT run_id, candidate_id, count(*) AS n_scores, round(avg({_quantile_sql("CAST(p AS DOUBLE)")}), 9) AS combined FROM pct GROUP BY 1, 2),
  items AS (SELECT cur.run_id, cur.candidate_id, coalesce(n_scores, 0) AS n_scores, combined FROM cur LEFT JOIN z ON z.candidate_id = cur.candidate_id AND z.run_id IS NOT DISTINCT FROM cur.run_id)"""
    classes = f"""{_P2}, sets AS (SELECT candidate_id, string_agg(v, chr(1) ORDER BY v) AS key FROM vals GROUP BY 1), eq AS (SELECT *, min(candidate_id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS n_equal FROM sets),
  good AS (SELECT x, y FROM over WHERE o >= 0.85 * (nx + ny - o) - 1e-9), ends AS (SELECT x AS a, y AS b FROM good UNION ALL SELECT y, x FROM good),
  cnt AS (SELECT a, count(*) AS n FROM ends JOIN sets s ON s.candidate_id = a JOIN sets r ON r.candidate_id = b WHERE s.key <> r.key GROUP BY 1)"""
    clusters = f"""{_P1.replace("WITH ", "WITH RECURSIVE ", 1)}, duo AS (SELECT x AS a, y AS b FROM linked UNION SELECT y, x FROM linked),
  reach AS (SELECT a, b FROM duo UNION SELECT reach.a, duo.b FROM reach JOIN duo ON duo.a = reach.b), rep AS (SELECT a AS id, min(least(a, b)) AS class_id FROM reach GROUP BY 1),
  n AS (SELECT a AS id, count(*) AS n FROM duo GROUP BY 1), ids AS (SELECT DISTINCT id FROM src)"""
    of = lambda purpose: f"documents CROSS JOIN (SELECT DISTINCT budget_id, max_tokens FROM token_budgets WHERE lower(purpose) = '{purpose}' AND max_tokens > 0) b"
    return {
        "p8_roundtrip": "SELECT doc_id, coalesce(text, '') = '' AS empty, sha256(coalesce(text, '')) AS sha FROM documents",
        "p9_items": f"SELECT budget_id, doc_id, true AS complete, true AS numbered, true AS whole FROM {of('pack')}",
        "p9_loads": "SELECT DISTINCT budget_id, CAST(0 AS BIGINT) AS over, true AS gapless, true AS tight FROM token_budgets WHERE lower(purpose) = 'pack' AND max_tokens > 0",
        "p10_cover": f"SELECT budget_id, doc_id, sha256(coalesce(text, '')) AS sha, true AS fits, true AS overlapping FROM {of('split')}",
        "p1_clusters": f"{clusters} SELECT id, coalesce(class_id, id) AS class_id, coalesce(n, 0) AS n_links FROM ids LEFT JOIN rep USING (id) LEFT JOIN n USING (id)",
        "p2_classes": f"{classes} SELECT candidate_id, class_id, n_equal, coalesce(n, 0) AS n_links FROM eq LEFT JOIN cnt ON a = candidate_id",
        "p6_ranking": f"{ranked} SELECT run_id, candidate_id, n_scores, round(combined, 6) AS combined, row_number() OVER (PARTITION BY run_id ORDER BY combined DESC NULLS LAST, candidate_id) AS position FROM items",
        "p1_links": f"""{_P1}, ends AS (SELECT id, any_value(fp) FILTER (WHERE length(fp) = 64) AS fp, any_value(t[1]) AS root, max(n) AS n FROM keyed LEFT JOIN sizes USING (id) GROUP BY 1),
  sims AS (SELECT l.x, l.y, a.fp AS fa, b.fp AS fb, a.root AS ra, b.root AS rb, a.n AS na, b.n AS nb, CASE WHEN o >= 0.6 * (a.n + b.n - o) - 1e-9 THEN o / (a.n + b.n - o) END AS s FROM linked l JOIN ends a ON a.id = l.x JOIN ends b ON b.id = l.y LEFT JOIN over ON over.x = l.x AND over.y = l.y)
  SELECT x AS earlier_id, y AS proposal_id, CASE WHEN fa IS NULL OR fb IS NULL THEN 'missing' WHEN fa = fb THEN 'equal' ELSE 'different' END AS fingerprint,
    CASE WHEN s >= 1 THEN 'same' WHEN s >= 0.8 THEN 'close' WHEN s IS NOT NULL THEN 'similar' WHEN na IS NULL OR nb IS NULL THEN 'missing' ELSE 'below' END AS terms,
    CASE WHEN ra IS NULL OR rb IS NULL THEN 'missing' WHEN ra = rb THEN 'equal' ELSE 'different' END AS root, round(s, 6) AS similarity FROM sims""",
        "p1_found": f"{_P1} SELECT x AS earlier_id, y AS proposal_id FROM linked",
        "p3_found": f"{_P3} SELECT DISTINCT least(a, b) AS record_a, greatest(a, b) AS record_b FROM near",
        "p3_neighbors": f"{_P3} SELECT dataset_id, a AS record_id, b AS neighbor_id, round(d, 6) AS distance, place FROM near",
    }
