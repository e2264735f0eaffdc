import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plainly import values

from panelforge.expr.analysis import analyze, semantic_fingerprint
from panelforge.expr.canonical import canonical, fingerprint, scalar_text
from panelforge.expr.catalog import Catalog, CatalogError, ValidationError, builtin
from panelforge.expr.descriptor import describe, distance, shares_ancestor
from panelforge.expr.parser import FormulaSyntaxError, NonSignalRoot, parse
from panelforge.expr.rewrite import Dialect, DialectError, compile_dialect, reduce_unit_scaling
from panelforge.expr.tree import PathError, paths, replace_subtree, show, subtree_at
from panelforge.search.scoring import Mask, mask_distance
from panelforge.search.transform import MUTATIONS, Limits, cover, crossover, mutate, read_back, sample, valid


@pytest.mark.parametrize("text", ["", "rank(", "rank(close", ".5", "close open", "multiply(close, 1e)", "winsorize(close, std=1, std=2)", "winsorize(std=1, close)", 'group_rank(close, group("a\\"))', "multiply(close, +)", "rank(close))", "rank(close$)"])
def test_syntax_errors(text):
    with pytest.raises(FormulaSyntaxError):
        parse(text)


@pytest.mark.parametrize("text", ["foo(close)", "bar", "ts_mean(close, 1)", "ts_mean(close, 2.5)", "ts_mean(close, 513)", "divide(close, 0)", "divide(close, open)", "add(close)", "add(close, 2)", "multiply(2, 3)", "clip(close, lower=1, upper=1)", "clip(close, lower=1)", "winsorize(close)", "winsorize(close, std=11)", 'rank(group("sector"))', 'group_rank(close, group("moon"))'])
def test_rule_errors(text):
    with pytest.raises(ValidationError):
        parse(text)


@pytest.mark.parametrize("text", ["5", "true", "greater(close, 1)", 'group("sector")'])
def test_roots_must_be_signals(text):
    with pytest.raises(NonSignalRoot):
        parse(text)


def test_byte_offsets():
    with pytest.raises(FormulaSyntaxError) as e:
        parse("rank(close) é")
    assert e.value.offset == 12


@pytest.mark.parametrize(("text", "want"), [
    ("add( open ,close )", "add(close, open)"), ("multiply(close, 5.)", "multiply(5, close)"), ("multiply(close, -.5, +2)", "multiply(-0.5, 2, close)"), ("clip(close, upper=2, lower=-0)", "clip(close, lower=0, upper=2)"), ("ts_mean(close, 5,)", "ts_mean(close, 5)"),
])
def test_canonical_text(text, want):
    assert canonical(parse(text)) == want and canonical(parse(want)) == want


def test_scalars_never_have_an_exponent():
    assert [scalar_text(x) for x in (0.0, -0.0, 2.0, 0.1, 1e21, 1e-7, -2.5)] == ["0", "0", "2", "0.1", "1" + "0" * 21, "0.0000001", "-2.5"]


def grown(seed):
    """A random formula and a random panel of 6 assets x 40 rows to try it on."""
    node, _ = sample(seed, 0, Limits(max_depth=4, max_nodes=16, max_window=6), builtin())
    rng = np.random.default_rng(seed)
    return node, {f.name: rng.normal(size=(40, 6)) * 3 for f in builtin().fields}


def proportional(a, b):
    """Whether b is a positive multiple of a wherever both are there."""
    both = ~np.isnan(a) & ~np.isnan(b)
    if not both.any() or not np.isfinite(a[both]).all() or np.abs(a[both]).max() < 1e-9:
        return True
    at = np.abs(a[both]).argmax()
    factor = b[both][at] / a[both][at]
    return factor > 0 and np.allclose(b[both], factor * a[both], rtol=1e-6, atol=1e-6 * np.abs(b[both]).max())


@given(st.integers(0, 100_000))
@settings(max_examples=80, deadline=None)
def test_the_normal_form_computes_the_same_but_for_a_positive_factor(seed):
    node, panel = grown(seed)
    assert proportional(values(parse(analyze(node).semantic_canonical), panel), values(node, panel))


@given(st.integers(0, 100_000), st.integers(2, 90), st.integers(0, 5))
@settings(max_examples=80, deadline=None)
def test_what_may_be_wrapped_around_a_formula_without_a_change_of_meaning(seed, k, form):
    """Positive scales, equal addends and idle conditionals around the root are no other formula; signs are."""
    text = canonical(grown(seed)[0])
    same = [f"multiply({text}, {k})", f"divide({text}, {k})", f"add({text}, {text})", f"multiply(-1, {text}, -{k})", f"if_else(greater(open, {k}), {text}, {text})", f"if_else(false, high, {text})"][form]
    want = semantic_fingerprint(parse(text))
    assert semantic_fingerprint(parse(same)) == want
    ranked = semantic_fingerprint(parse(f"rank({text})"))
    assert semantic_fingerprint(parse(f"rank(rank({text}))")) == ranked != semantic_fingerprint(parse(f"rank(ts_delay({text}, {k}))"))
    if analyze(parse(text)).rejection_reason is None:
        assert semantic_fingerprint(parse(f"multiply({text}, -{k})")) != want


@given(st.integers(0, 100_000), st.integers(2, 5))
@settings(max_examples=80, deadline=None)
def test_proofs_of_triviality_hold_on_numbers(seed, w):
    """What is proven zero or constant is so on a random panel: in any formula drawn, and in windows over a difference of equals."""
    node, panel = grown(seed)
    text = canonical(node)
    rolling = ["ts_mean", "ts_sum", "ts_std_dev", "ts_delta", "ts_rank", "ts_skew", "ts_corr"][seed % 7]
    zero = f"subtract({text}, {text})"
    over = f"{rolling}({zero}, volume, {w})" if rolling == "ts_corr" else f"{rolling}({zero}, {w})"
    assert analyze(parse(zero)).rejection_reason == "provably_zero"
    for t in (text, zero, over, f"add({over}, {zero})", f"zscore({zero})", f"multiply({over}, 0)"):
        n = parse(t)
        reason, x = analyze(n).rejection_reason, values(n, panel)
        known = x[~np.isnan(x)]
        if reason == "provably_zero":
            assert np.allclose(known, 0)
        elif reason is not None:
            assert all(np.ptp(c[~np.isnan(c)]) < 1e-9 for c in x.T if (~np.isnan(c)).any())
    assert analyze(parse(over)).rejection_reason == {"ts_rank": "provably_constant", "ts_skew": None, "ts_corr": None}.get(rolling, "provably_zero")


def test_catalog_round_trip_and_rules():
    c = builtin()
    assert len(c.operators) == 32 and Catalog.from_json(c.to_json()).checksum == c.checksum
    with pytest.raises(CatalogError):
        Catalog.from_json(c.to_json().replace('"negate"', '"abs"'))
    with pytest.raises(CatalogError):
        Catalog.from_json("[]")


def test_dialect_and_unit_scaling():
    d = Dialect("t", frozenset(["multiply", "rank"]), frozenset(["close"]), {"negate": ("multiply", -1.0)})
    out = compile_dialect("negate(rank(negate(close)))", d)
    assert out.compiled_expression == "multiply(-1, rank(multiply(-1, close)))" and out.lowerings_applied == ("negate->multiply",) * 2
    for bad in ("rank(open)", "abs(close)"):
        with pytest.raises(DialectError):
            compile_dialect(bad, d)
    assert [canonical(reduce_unit_scaling(parse(t))) for t in ("rank(multiply(1, close))", "divide(close, 1)", "multiply(close, 1, open)", "multiply(2, close)")] == ["rank(close)", "close", "multiply(1, close, open)", "multiply(2, close)"]


def test_paths_and_replacement():
    n = parse('if_else(greater(close, 1), group_rank(open, group("sector")), winsorize(low, std=2))')
    assert [show(n, e.path) for e in paths(n)] == ["$", "$.args[0]", "$.args[0].left", "$.args[0].right", "$.args[1]", "$.args[1].left", "$.args[1].right", "$.args[2]", "$.args[2].arg", "$.args[2].kwargs.std"]
    assert canonical(replace_subtree(n, (2, 0), parse("rank(high)"))).endswith("winsorize(rank(high), std=2))")
    for path, new in (((0, 1), parse("close")), ((2, "std"), parse("close"))):
        with pytest.raises(PathError):
            replace_subtree(n, path, new)
    with pytest.raises(PathError):
        subtree_at(n, (9,))


def test_descriptor_distance():
    a, b = describe(parse("rank(ts_mean(close, 5))"), ["p"]), describe(parse("rank(ts_mean(volume, 100))"), ["p"])
    assert a.operator_shingles == ("rank>ts_mean",) and a.window_buckets == {"short": 1} and b.window_buckets == {"long": 1}
    assert distance(a, a) == 0 and abs(distance(a, b) - mask_distance(Mask(a), Mask(b))) < 1e-12 and 0 < distance(a, b) < 1 and shares_ancestor(a, b) == 1
    assert a.signature != b.signature and fingerprint(parse("close")) != fingerprint(parse("open"))


@given(st.integers(0, 10_000), st.integers(0, 50))
@settings(max_examples=60, deadline=None)
def test_generated_formulas_are_typed_bounded_and_repeatable(seed, index):
    c, limits = builtin(), Limits(max_depth=5, max_nodes=25)
    node, p = sample(seed, index, limits, c)
    other, _ = sample(seed, index + 1, limits, c)
    assert valid(node, limits, c) and sample(seed, index, limits, c) == (node, p)
    child, q = mutate(node, seed, index, limits, c, applicable=index % 2 == 0)
    both, r = crossover(node, other, seed, index, limits, c, same_path=index % 3 == 0)
    assert valid(child, limits, c) and valid(both, limits, c) and mutate(node, seed, index, limits, c, applicable=index % 2 == 0)[0] == child
    assert q.kind in ("mutation", "fallback_generation") and r.kind in ("crossover", "fallback_generation")
    assert (q.parent_fingerprints == (fingerprint(node),)) is (q.kind == "mutation")


def test_each_mutation_class_can_succeed():
    n = parse('if_else(true, group_rank(ts_mean(close, 5), group("sector")), winsorize(multiply(open, 3), std=2))')
    for cls, operation in MUTATIONS.items():
        done = [mutate(n, s, 0, Limits(), builtin(), cls)[1] for s in range(8)]
        assert any(p.kind == "mutation" and p.operation == operation for p in done), cls


@pytest.mark.parametrize("policy", ["fixed", "seeded_diverse", "motif_diverse"])
def test_covers(policy):
    a, b = cover(policy, 1, Limits(), builtin()), cover(policy, 1, Limits(), builtin())
    assert len(a) == 64 and a == b and len({semantic_fingerprint(n) for n, _ in a}) == 64 and all(valid(n, Limits(), builtin()) for n, _ in a)


@given(st.integers(0, 100_000))
@settings(max_examples=60, deadline=None)
def test_a_tree_put_in_order_is_the_tree_of_its_text(seed):
    node = grown(seed)[0]
    assert read_back(node, builtin()) == parse(canonical(node)) and canonical(read_back(node, builtin())) == canonical(node)
