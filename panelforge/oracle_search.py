"""SQL (DuckDB) that the queries of ``queries_search`` are held against."""

from __future__ import annotations

from panelforge.oracle_core import _CURRENT, _EVAL, _EVENTS, _FB, _EST, _PREP, _TIDY, _six

_DESCRIBED = "SELECT DISTINCT ON (candidate_id) candidate_id, expression, fingerprint, nodes, depth, structural_descriptor AS d FROM candidates WHERE candidate_id IS NOT NULL AND structural_descriptor IS NOT NULL"
_SETS = ("operator_shingles", "ordered_paths", "fields", "field_families", "groups", "lineage_parents")
_CLEAN = "list_distinct(list_transform(list_filter(coalesce({0}, []), lambda v: v IS NOT NULL), lambda v: " + _TIDY.format("v") + "))"
_WEIGHTS = {"operator_shingles": 0.24, "ordered_paths": 0.16, "fields": 0.08, "field_families": 0.10, "groups": 0.05, "lineage_parents": 0.05, "operator_histogram": 0.14, "window_buckets": 0.08}


def _facts(*names: str) -> str:
    return "SELECT fact, true AS holds FROM (VALUES " + ", ".join("('" + n.replace("'", "''") + "')" for n in names) + ") f(fact)"


_EVENT = """e AS (SELECT event_id, list_extract(['close', 'open', 'high', 'low', 'volume'], CAST(user_id % 5 + 1 AS BIGINT)) AS a, list_extract(['close', 'open', 'high', 'low', 'volume'], CAST((event_id + user_id * 3) % 5 + 1 AS BIGINT)) AS b,
  CAST(event_id % 50 + 2 AS VARCHAR) AS w FROM events)"""


def _by_event(*cases: str) -> str:
    return "CASE event_id % " + str(len(cases)) + " " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def _distance(a: str, b: str) -> str:
    """Between two rows with cleaned lists, maps as structs d, and flags."""
    part = lambda n: f"{_WEIGHTS[n]} * CASE WHEN len(list_distinct(list_concat({a}.{n}, {b}.{n}))) = 0 THEN 0 ELSE 1 - len(list_intersect({a}.{n}, {b}.{n})) / len(list_distinct(list_concat({a}.{n}, {b}.{n}))) END"
    # a histogram as a list of (key, number of the occurrence): what both have of the same is their overlap
    both = lambda n: f"{_WEIGHTS[n]} * CASE WHEN len({a}.{n}) + len({b}.{n}) = 0 THEN 0 ELSE 1 - len(list_intersect({a}.{n}, {b}.{n})) / (len({a}.{n}) + len({b}.{n}) - len(list_intersect({a}.{n}, {b}.{n}))) END"
    flags = f"0.10 * (CAST({a}.nl <> {b}.nl AS INTEGER) + CAST({a}.co <> {b}.co AS INTEGER)) / 2"
    return " + ".join([*map(part, _SETS), both("operator_histogram"), both("window_buckets"), flags])


def _score_components() -> str:
    spread = lambda n: f"flatten(list_transform(map_entries(coalesce(d.{n}, MAP {{}})), lambda e: list_transform(range(e.value), lambda i: e.key || '|' || i))) AS {n}"
    lists = ", ".join(f"{_CLEAN.format('d.' + n)} AS {n}" for n in _SETS)
    weights = {"simplicity": 0.2, "archive_novelty": 0.15, "family_diversity": 0.1, "lineage_diversity": 0.1, "structural_novelty": 0.35, "transform_diversity": 0.1}
    total = " + ".join(f"{w} * {c}" for c, w in weights.items())
    return f"""WITH {_CURRENT}, c0 AS (SELECT candidate_id, run_id, {_TIDY.format("root_family")} AS family, provenance.kind AS kind, nodes, structural_descriptor AS d, coalesce(list_sum(map_values(structural_descriptor.operator_histogram)), 0) AS ops FROM cur WHERE structural_descriptor IS NOT NULL AND run_id IS NOT NULL),
  c AS (SELECT candidate_id, run_id, family, kind, nodes, ops, coalesce(d.nonlinear, false) AS nl, coalesce(d.conditional, false) AS co, {lists}, {spread("operator_histogram")}, {spread("window_buckets")},
    row_number() OVER (PARTITION BY run_id ORDER BY candidate_id) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM c0),
  arch AS (SELECT * FROM c WHERE run_id = (SELECT min(run_id) FROM c) ORDER BY candidate_id LIMIT 64), an AS (SELECT c.candidate_id, min({_distance("c", "arch")}) AS archive_novelty FROM c CROSS JOIN arch GROUP BY 1),
  ask AS (SELECT candidate_id, run_id, k * greatest(1, (n - 1) // 16) AS j, i, n FROM c, range(16) r(k)), peer AS (SELECT candidate_id, run_id, j + CASE WHEN j >= i THEN 1 ELSE 0 END AS j FROM ask WHERE j < n - 1),
  sn AS (SELECT c.candidate_id, min({_distance("c", "p")}) AS structural_novelty FROM peer JOIN c USING (candidate_id) JOIN c p ON p.run_id = peer.run_id AND p.i = peer.j GROUP BY 1),
  parts AS (SELECT candidate_id, 1 / (1 + ops + nodes / 10.0) AS simplicity, archive_novelty, 1 / sqrt(count(*) OVER (PARTITION BY run_id, family)) AS family_diversity, least(len(lineage_parents) / 2, 1) AS lineage_diversity, coalesce(structural_novelty, 1) AS structural_novelty,
    1 / sqrt(count(*) OVER (PARTITION BY run_id, kind)) AS transform_diversity FROM c JOIN an USING (candidate_id) LEFT JOIN sn USING (candidate_id))
  SELECT candidate_id, {_six(list(weights))}, round({total}, 6) + 0.0 AS structural_score FROM parts"""


def oracle_sql() -> dict[str, str]:
    from panelforge.expr.catalog import builtin
    from panelforge.search import session, transform

    tidy_text = "regexp_replace(regexp_replace(expression, '\\s+', '', 'g'), ',', ', ', 'g')"
    cleaned = lambda n: _CLEAN.format("d." + n)
    held = "substr(md5(record_id), 1, 1) IN ('0', '1', '2', '3')"
    retention = " + ".join(f"{w} * coalesce(len({'map_keys' if n in ('operator_histogram', 'window_buckets') else 'list_distinct'}({'d.' + n if n in ('operator_histogram', 'window_buckets') else f'list_filter(d.{n}, lambda v: v IS NOT NULL)'})), 0)" for n, w in (("operator_shingles", 8), ("operator_histogram", 5), ("field_families", 7), ("fields", 3), ("window_buckets", 4), ("groups", 5), ("lineage_parents", 2)))
    bucket = "CASE WHEN nodes <= 5 THEN 0 WHEN nodes <= 12 THEN 1 WHEN nodes <= 24 THEN 2 WHEN nodes <= 48 THEN 3 WHEN nodes <= 96 THEN 4 ELSE 5 END"
    weights = ", ".join(f"('{o.name}', {o.weight})" for o in builtin().operators)
    classes = ", ".join(f"'{c}'" for c in transform.MUTATIONS)
    return {
        "formula_identity": "SELECT DISTINCT candidate_id, expression AS canonical, fingerprint, nodes, depth, CAST(NULL AS VARCHAR) AS error FROM candidates WHERE candidate_id IS NOT NULL",
        "proposals_identity": f"WITH p AS (SELECT DISTINCT proposal_id, expression, {tidy_text} AS t FROM measured_proposals WHERE proposal_id IS NOT NULL) SELECT proposal_id, CASE WHEN t = lower(t) THEN array_to_string(list_sort(string_split_regex(t, '[(), ]+')), ' ') END AS terms FROM p",
        "formula_texts": f"""WITH {_EVENT} SELECT event_id, {_by_event(
            "'add(' || array_to_string(list_sort([a, b, 'volume']), ', ') || ')'", "'multiply(' || array_to_string(list_sort([a, w || '.5', '-0.5']), ', ') || ')'", "'clip(' || a || ', lower=0, upper=' || w || ')'", "'ts_corr(' || a || ', ' || b || ', ' || w || ')'",
            "'if_else(true, ' || a || ', ' || b || ')'", "'group_rank(' || a || ', group(\"sector\"))'", "'winsorize(' || a || ', std=1)'", "'multiply(' || least(a, b) || ', ' || greatest(a, b) || ')'")} AS canonical, CAST(NULL AS VARCHAR) AS error FROM e""",
        "formula_meaning": f"""WITH {_EVENT}, z AS (SELECT *, 'subtract(' || a || ', ' || a || ')' AS zero FROM e) SELECT event_id, {_by_event(
            "'rank(' || a || ')'", "'ts_mean(' || a || ', ' || w || ')'", "a", "'multiply(-1, ' || a || ')'", "'rank(zscore(' || a || '))'", "'abs(' || a || ')'", "zero", "'ts_std_dev(' || zero || ', ' || w || ')'", "'ts_rank(' || zero || ', ' || w || ')'", "'zscore(' || zero || ')'",
            "'ts_skew(' || zero || ', ' || w || ')'", "'ts_delta(' || b || ', ' || w || ')'")} AS meaning, {_by_event(*["NULL"] * 6, "'provably_zero'", "'provably_zero'", "'provably_constant'", "'provably_constant'", "NULL", "NULL")} AS reason FROM z""",
        "formula_unit_scaling": "SELECT DISTINCT candidate_id, expression AS reduced FROM candidates WHERE candidate_id IS NOT NULL",
        "formula_dialect": "WITH c AS (SELECT DISTINCT candidate_id, expression, NOT regexp_matches(expression, '(ts_kurt|ts_skew|winsorize)\\(') AS accepted FROM candidates WHERE candidate_id IS NOT NULL) SELECT candidate_id, accepted, CAST(CASE WHEN accepted THEN len(regexp_extract_all(expression, 'negate\\(')) ELSE 0 END AS INTEGER) AS lowered FROM c",
        "catalog_fields_back": "SELECT field_name, field_kind, CASE WHEN field_kind = 'signal' THEN family END AS family, true AS same FROM catalog_fields WHERE field_name IS NOT NULL",
        "tree_paths": f"WITH c AS ({_DESCRIBED}), v AS (SELECT candidate_id, unnest({cleaned('ordered_paths')}) AS v FROM c) SELECT candidate_id, replace(regexp_replace(split_part(v, ':', 1), '\\.arg(\\d+)', '.args[\\1]', 'g'), '.kw.', '.kwargs.') AS path, true AS same FROM v",
        "tree_replace": "WITH c AS (SELECT DISTINCT candidate_id, expression FROM candidates WHERE candidate_id IS NOT NULL AND regexp_matches(expression, '^ts_') AND NOT regexp_matches(expression, '^ts_(corr|cov)\\(')), r AS (SELECT candidate_id, regexp_replace(expression, '^(ts_[a-z_]+)\\((.*), (\\d+)\\)$', '\\1(rank(\\2), \\3)') AS changed FROM c) SELECT candidate_id, changed, sha256(changed) AS fingerprint, true AS refused FROM r",
        "formula_descriptors": f"""WITH c AS ({_DESCRIBED}) {" UNION ALL ".join(f"SELECT candidate_id, '{n}' AS part, unnest({cleaned(n)}) AS value, 1 AS n FROM c" for n in ("operator_shingles", "ordered_paths", "fields", "groups"))}
  UNION ALL SELECT DISTINCT candidate_id, 'field_families', coalesce(family, 'public:' || f), 1 FROM (SELECT candidate_id, unnest({cleaned("fields")}) AS f FROM c) JOIN catalog_fields ON field_name = f
  {"".join(f" UNION ALL SELECT candidate_id, '{n}', e.key, e.value FROM (SELECT candidate_id, unnest(map_entries(d.{n})) AS e FROM c)" for n in ("operator_histogram", "window_buckets"))}
  UNION ALL SELECT candidate_id, 'flags', 'nonlinear', CAST(d.nonlinear AS INTEGER) FROM c UNION ALL SELECT candidate_id, 'flags', 'conditional', CAST(d.conditional AS INTEGER) FROM c""",
        "descriptor_twins": f"""WITH c AS ({_DESCRIBED}), k AS (SELECT candidate_id, md5(array_to_string(list_concat({", ".join(f"list_concat(list_sort({cleaned(n)}), ['#'])" for n in ("operator_shingles", "ordered_paths"))}), '|') || array_to_string(list_sort({cleaned('fields')}), '|')) AS key FROM c)
  SELECT candidate_id, min(candidate_id) OVER (PARTITION BY key) AS first FROM k""",
        "descriptor_ancestors": f"""WITH {_CURRENT}, c AS (SELECT candidate_id, run_id, {_CLEAN.format('structural_descriptor.lineage_parents')} AS p FROM cur WHERE structural_descriptor.lineage_parents IS NOT NULL AND run_id IS NOT NULL), f AS (SELECT run_id, arg_min(p, candidate_id) AS q FROM c GROUP BY 1)
  SELECT candidate_id, CAST(list_has_any(p, q) AS INTEGER) AS common FROM c JOIN f USING (run_id)""",
        "gp_samples": "SELECT event_id, true AS valid, true AS bounded, true AS repeated, true AS reads_back FROM events",
        "gp_fields": "SELECT count(*) AS formulas, true AS as_weighted FROM events",
        "gp_mutations": f"SELECT DISTINCT candidate_id, list_extract([{classes}], CAST(candidate_id % {len(transform.MUTATIONS)} + 1 AS BIGINT)) AS class, true AS valid, true AS told, true AS applicable FROM candidates WHERE candidate_id IS NOT NULL",
        "gp_crossovers": "WITH c AS (SELECT DISTINCT candidate_id FROM candidates WHERE candidate_id IS NOT NULL) SELECT a.candidate_id, same_path, true AS valid, true AS named FROM c a JOIN c b ON b.candidate_id = a.candidate_id + 1 CROSS JOIN (VALUES (true), (false)) s(same_path)",
        "gp_limits": f"WITH c AS ({_DESCRIBED}) SELECT candidate_id, depth <= 5 AND nodes <= 20 AND coalesce(list_sum(map_values(d.operator_histogram)), 0) <= 8 AS within FROM c",
        "gp_covers": "SELECT policy, CAST(seed AS INTEGER) AS seed, 64 AS formulas, true AS usable, true AS repeated FROM (VALUES ('fixed'), ('seeded_diverse'), ('motif_diverse')) p(policy), range(3) r(seed)",
        "score_components": _score_components(),
        "scored_order": f"WITH {_CURRENT} SELECT candidate_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN isnan(structural_score) THEN NULL ELSE structural_score END DESC NULLS LAST, nodes NULLS FIRST, fingerprint NULLS FIRST, candidate_id) AS place FROM cur",
        "elite_archive": f"""WITH {_CURRENT}, c AS (SELECT candidate_id, provenance.kind AS kind, {_TIDY.format('root_family')} AS family, nodes, structural_descriptor AS d, semantic_fingerprint AS fp FROM cur WHERE structural_descriptor IS NOT NULL AND root_family IS NOT NULL AND provenance.kind IS NOT NULL AND nodes IS NOT NULL),
  w AS (SELECT candidate_id, coalesce(list_position(['initial', 'mutation', 'crossover', 'fallback_generation'], kind), 0) AS k, family, {bucket} AS b, nodes, fp, CAST({retention} + CASE WHEN d.nonlinear THEN 3 ELSE 0 END + CASE WHEN d.conditional THEN 5 ELSE 0 END AS INTEGER) AS worth FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY k, family, b ORDER BY worth DESC, nodes, fp NULLS LAST, candidate_id) AS rn FROM w) SELECT candidate_id, worth FROM r ORDER BY rn, k, family, b LIMIT 300""",
        "search_records": "SELECT CAST(place AS INTEGER) AS place, true AS named, true AS scored, true AS sized, true AS own_meaning FROM range(1, 41) r(place)",
        "search_counts": "SELECT counter, CAST(n AS BIGINT) AS n, 'max_candidates' AS termination FROM (VALUES ('attempted', 1024), ('generations', 3), ('shortlist', 40), ('accounted', 1024)) c(counter, n)",
        "search_facts": _facts(
            "a run is repeated", "executors and driver make the same", "a resumed run ends the same", "a checkpoint of another run is refused", "what the archive holds never comes out", "an archive makes another run", "an archive's checksum knows no order and no copies",
            "frozen parents are those of the archive", "no child of an archive is its formula", "measured outcomes move the policy", "guided records come before others", "a deadline ends a run", "elites are bounded", "forgotten identities come back",
            "bounds of a specification are kept", "options must fit together", "a search catalog has built-in operators only", "children have seeds of their own", "half of a shortlist is from the cover at most",
        ),
        "session_facts": _facts(
            *(f"{p}: batches repeat, restored sessions agree, all is measured once" for p in session.PARENT_POLICIES), "bad snapshots change nothing", "screened proposals are counted and gone", "broken checkpoints are refused", "another configuration is refused",
            "measured seeds are parents and history is never proposed", "a referred history must be given again", "bounds of a configuration are kept", "the bridge answers line by line",
        ),
        "artifact_candidates": "SELECT run_id, expression, fingerprint, round(structural_score, 9) AS structural_score, nodes, depth, CAST(len(structural_descriptor.ordered_paths) AS INTEGER) AS paths, provenance.kind AS kind FROM candidates WHERE expression IS NOT NULL",
        "artifact_facts": _facts(
            "what is published is read back", "publishing again changes nothing", "records of another run are refused", "nothing temporary is left", "a file isn't overwritten unasked", "altered files are noticed", "an unknown schema is named by its line", "a checkpoint has its schema and run",
            "a feedback dataset's checksum knows no order", "broken feedback datasets are refused", "bounds of the guidance are kept", "a dialect is read", "bad catalogs are refused",
        ),
        "panel_json": f"{_EVENTS} SELECT ts, asset, {_six(['open', 'high', 'low', 'close', 'volume'])} FROM panel",
        "hive_universe": _PREP,
        "eval_batch": f"""{_EVAL}, good AS (SELECT observations, mean_gross FROM per JOIN pr USING (split) WHERE split = 'overall')
  SELECT CAST(place AS INTEGER) AS place, status, CASE WHEN status = 'succeeded' THEN observations END AS observations, CASE WHEN status = 'succeeded' THEN round(mean_gross, 6) + 0.0 END AS mean_gross
  FROM (VALUES (1, 'failed'), (2, 'succeeded'), (3, 'failed'), (4, 'succeeded'), (5, 'failed')) v(place, status) CROSS JOIN good""",
        "eval_record": f"{_EVAL} SELECT split, observations, {_six(['mean_gross', 'net_sharpe'])} FROM per JOIN pr USING (split)",
        "feedback_holdout": f"""{_FB}, tr AS (SELECT * FROM num WHERE NOT ({held})), ev AS (SELECT * FROM num WHERE {held} AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.dataset_id = num.dataset_id AND tr.semantic_fingerprint = num.semantic_fingerprint)),
  dist AS (SELECT a.dataset_id, a.record_id AS a, b.record_id AS b, any_value(b.outcome) AS o, any_value(b.confidence) AS c, avg(least(abs(a.v - b.v) / a.s, 1)) AS d FROM ev a JOIN tr b ON a.dataset_id = b.dataset_id AND a.k = b.k GROUP BY 1, 2, 3),
  {_EST}, act AS (SELECT DISTINCT dataset_id, record_id, outcome AS a FROM ev), pred AS (SELECT act.*, weighted_outcome AS p FROM act LEFT JOIN est ON query = record_id AND est.dataset_id = act.dataset_id)
  SELECT dataset_id, count(*) AS records, count(p) AS predicted, round(count(p) / count(*), 6) + 0.0 AS coverage, round(avg(abs(p - a)), 6) + 0.0 AS mae, round(sqrt(avg(power(p - a, 2))), 6) + 0.0 AS rmse FROM pred GROUP BY 1""",
        "feedback_policy": f"""{_FB}, ops(operator, weight) AS (VALUES {weights}), kept AS (SELECT num.*, operator FROM num JOIN ops ON k = 'operator_' || operator || '_count' WHERE weight > 0),
  overall AS (SELECT dataset_id, sum(outcome * confidence) / sum(confidence) AS m FROM (SELECT DISTINCT dataset_id, record_id, outcome, confidence FROM num) GROUP BY 1),
  cen AS (SELECT kept.dataset_id, operator, sum(outcome * confidence * v) / sum(confidence * v) - any_value(m) AS c FROM kept JOIN overall USING (dataset_id) WHERE v > 0 GROUP BY 1, 2 HAVING count(*) >= 3), most AS (SELECT dataset_id, max(abs(c)) AS m FROM cen GROUP BY 1)
  SELECT d.dataset_id, ops.operator, CAST(CASE WHEN weight = 0 THEN 0 ELSE least(greatest(floor(weight * 10 * least(greatest(1 + 0.5 * CASE WHEN m > 0 THEN coalesce(c, 0) / m ELSE 0 END, 0.25), 4.0) + 0.5), 1), 65535) END AS INTEGER) AS weight
  FROM (SELECT DISTINCT dataset_id FROM kept) d CROSS JOIN ops LEFT JOIN cen ON cen.dataset_id = d.dataset_id AND cen.operator = ops.operator LEFT JOIN most ON most.dataset_id = d.dataset_id""",
        "cli_facts": _facts(
            "doctor", "inspect", "inspect refuses", "search", "dedup", "dedup refuses its own input", "benchmark", "evaluate", "evaluate-batch", "prioritize", "screen-feedback", "audit-feedback", "compile", "prepare-panel", "prepare-panel refuses an existing file",
        ),
    }
