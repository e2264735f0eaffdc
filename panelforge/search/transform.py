"""Random formulas under a catalog's grammar: sampling, mutation, crossover and starting covers.

Everything is a function of a seed and numbers; nothing depends on the order or place it runs in.
"""

from __future__ import annotations

import dataclasses
import hashlib
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from panelforge.expr import ast
from panelforge.expr.analysis import analyze
from panelforge.expr.ast import BOOLEAN, GROUP, SCALAR, SIGNAL, Node
from panelforge.expr.canonical import canonical, commutes, digest, fingerprint
from panelforge.expr.catalog import Catalog, Input, Keyword, Operator, ValidationError, build_call, is_checked
from panelforge.expr.parser import parse
from panelforge.expr.tree import PathError, paths, replace_subtree, show, subtree_at

#: Chance of a field where the depth would allow an operator, and of a literal where a truth value is wanted.
FIELD_CHANCE, LITERAL_CHANCE = 0.28, 0.4
RETRIES = 16
COVER_SIZE, COVER_UNIVERSE = 64, 4096
MOTIF_WINDOWS = (2, 5, 10, 20, 40)
#: What a motif may end in: a change of sign or a smoother that keeps the unit.
FINISHERS = ("abs", "ts_ema", "ts_mean", "ts_median", "ts_min")

KINDS = ("initial", "mutation", "crossover", "fallback_generation")
COVERS = ("catalog_scaffold", "seeded_catalog_scaffold", "motif_catalog_scaffold")
MUTATIONS = {
    "field": "mutate_field", "window": "mutate_window", "scalar": "mutate_scalar", "group": "mutate_group", "bounded_keyword": "mutate_bounded_keyword",
    "boolean_literal": "mutate_boolean_literal", "operator": "replace_compatible_operator", "subtree": "replace_typed_subtree",
}


@dataclass(frozen=True)
class Limits:
    max_depth: int = 6
    max_nodes: int = 40
    max_operators: int = 16
    min_window: int = 2
    max_window: int = 252
    max_scalar_abs: int = 1000

    def checked(self) -> Limits:
        if not (2 <= self.max_depth <= 64 and 3 <= self.max_nodes <= 4096 and 1 <= self.max_operators <= min(2048, self.max_nodes)):
            raise ValueError("depth 2..64, nodes 3..4096 and operators 1..min(2048, nodes) are required")
        if not 2 <= self.min_window <= self.max_window <= 512:
            raise ValueError("windows must be ordered within 2..512")
        if self.max_scalar_abs < 1:
            raise ValueError("max_scalar_abs must be positive")
        return self

    def accepts(self, node: Node, catalog: Catalog) -> bool:
        """Sizes, windows within the limits, scalars on the catalog's grid."""
        known = node.__dict__.get("_accepted")
        if known is None or known[0] is not self or known[1] is not catalog:
            small = node.depth <= self.max_depth and node.node_count <= self.max_nodes and node.operator_count <= self.max_operators
            known = node.__dict__["_accepted"] = (self, catalog, small and self._parameters(node, catalog))
        return known[2]

    def _parameters(self, node: Node, catalog: Catalog) -> bool:
        if node.tag == "number":
            lo, hi, step = catalog.scalar_domain
            at = (node.value - lo) / step
            return abs(node.value) <= self.max_scalar_abs and lo <= node.value <= hi and abs(at - round(at)) <= 1e-8
        if node.tag != "call":
            return True
        op = catalog.operator(node.name)
        if op is None:
            return False
        for i, a in enumerate(node.args):
            if _is_window(op.input(i)):
                if a.tag != "number" or a.value != int(a.value) or not self.min_window <= a.value <= self.max_window:
                    return False
            elif not self._parameters(a, catalog):
                return False
        return all(v.tag == "number" and abs(v.value) <= self.max_scalar_abs for _, v in node.kwargs)


@dataclass(frozen=True)
class Provenance:
    kind: str
    operation: str
    parent_fingerprints: tuple[str, ...] = ()
    requested_operation: str | None = None
    affected_path: str | None = None
    old_subtree_fingerprint: str | None = None
    new_subtree_fingerprint: str | None = None
    retry_count: int = 0

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)


def rng_for(*parts: object) -> random.Random:
    """A generator that depends on nothing but its parts."""
    return random.Random(int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:16], "little"))


def _is_window(spec: Input) -> bool:
    return bool(spec.domain) and spec.domain[0] in ("window", "window_set")


def windows_of(spec: Input, limits: Limits) -> list[int]:
    if spec.domain[0] == "window_set":
        return [w for w in spec.domain[1] if limits.min_window <= w <= limits.max_window]
    return list(range(max(spec.domain[1], limits.min_window), min(spec.domain[2], limits.max_window) + 1))


def valid(node: Node, limits: Limits, catalog: Catalog) -> bool:
    """A signal within the limits whose text reads back as the same formula."""
    if node.kind != SIGNAL or not limits.accepts(node, catalog):
        return False
    try:
        read_back(node, catalog)
    except ValueError:
        return False
    return True


def read_back(node: Node, catalog: Catalog) -> Node:
    """The tree that the formula's canonical text reads back as; made once.

    The text differs from a checked tree only in the order of commutative arguments, so those are put in order. A tree
    that wasn't built under this catalog is parsed.
    """
    known = node.__dict__.get("_read_back")
    if known is None or known[0] is not catalog:
        known = node.__dict__["_read_back"] = (catalog, _in_order(node, catalog) if is_checked(node, catalog) else parse(canonical(node), catalog))
    return known[1]


def _in_order(node: Node, catalog: Catalog) -> Node:
    if node.tag != "call":
        return node
    known = node.__dict__.get("_read_back")
    if known is not None and known[0] is catalog:
        return known[1]
    args = [_in_order(a, catalog) for a in node.args]
    if commutes(node.name):
        args.sort(key=canonical)
    if all(a is b for a, b in zip(args, node.args)):
        out = node
    else:
        out = node.with_parts(tuple(args))
        out.__dict__["_canonical"] = canonical(node)
        out.__dict__["_checked_by"] = catalog
    node.__dict__["_read_back"] = out.__dict__["_read_back"] = (catalog, out)
    return out


class Sampler:
    """Draws typed subtrees."""

    def __init__(self, rng: random.Random, limits: Limits, catalog: Catalog):
        self.rng, self.limits, self.catalog = rng, limits, catalog

    def scalar(self, nonzero: bool = False) -> Node:
        lo, hi, step = self.catalog.scalar_domain
        bound = self.limits.max_scalar_abs
        first, last = -int(-(max(lo, -bound) - lo) // step), int((min(hi, bound) - lo) // step)
        while True:
            value = lo + step * self.rng.randint(first, last)
            if value or not nonzero:
                return ast.number(value)

    def keyword(self, k: Keyword, below: float | None = None, above: float | None = None) -> Node | None:
        """A value of the keyword's grid, found by adding up its steps."""
        grid, value = [], k.min
        while value <= k.max + k.step * 1e-9:
            if (below is None or value < below) and (above is None or value > above):
                grid.append(min(value, k.max))
            value += k.step
        return ast.number(self.rng.choice(grid)) if grid else None

    def keywords(self, op: Operator) -> dict[str, Node]:
        for _ in range(100):
            drawn = {k.name: self.keyword(k) for k in op.keywords}
            if all(drawn[a].value < drawn[b].value for a, b in op.less_than):
                return drawn
        return {k.name: ast.number(k.min if all(k.name != b for _, b in op.less_than) else k.max) for k in op.keywords}

    def argument(self, spec: Input, depth: int) -> Node:
        if _is_window(spec):
            return ast.number(float(self.rng.choice(windows_of(spec, self.limits) or [self.limits.min_window])))
        if spec.domain and spec.domain[0] == "non_zero_scalar":
            return self.scalar(nonzero=True)
        return self.kind(self.rng.choice(sorted(spec.kinds)), depth)

    def call(self, op: Operator, depth: int) -> Node | None:
        args = [self.argument(op.input(i), depth - 1) for i in range(op.arity[0])]
        for k in op.required_kinds:
            if all(a.kind != k for a in args):
                args[self.rng.randrange(len(args))] = self.kind(k, depth - 1)
        try:
            return build_call(self.catalog, op.name, args, self.keywords(op))
        except ValidationError:
            return None

    def operators(self, kind: str) -> list[Operator]:
        return [o for o in self.catalog.operators if o.output == kind and o.weight > 0]

    def kind(self, kind: str, depth: int) -> Node:
        if kind == SCALAR:
            return self.scalar()
        if kind == GROUP:
            return ast.group(self.rng.choice(self.catalog.groups))
        choices = self.operators(kind)
        if kind == BOOLEAN and (depth <= 1 or not choices or self.rng.random() < LITERAL_CHANCE):
            return ast.boolean(self.rng.random() < 0.5)
        if kind == SIGNAL and (depth <= 1 or not choices or self.rng.random() < FIELD_CHANCE):
            return ast.field(self.rng.choice(self.catalog.fields).name)
        op = self.rng.choices(choices, [o.weight for o in choices])[0]
        return self.call(op, depth) or ast.field(self.rng.choice(self.catalog.fields).name)


def sample(seed: int, index: int, limits: Limits, catalog: Catalog, *, domain: str = "sample") -> tuple[Node, Provenance]:
    """A formula drawn from the grammar."""
    sampler = Sampler(rng_for(domain, seed, index), limits, catalog)
    for attempt in range(RETRIES + 1):
        node = sampler.kind(SIGNAL, sampler.rng.randint(2, limits.max_depth))
        if valid(node, limits, catalog):
            return node, Provenance("initial", "grammar_sample", retry_count=attempt)
    return ast.field(catalog.fields[index % len(catalog.fields)].name), Provenance("initial", "grammar_sample", retry_count=RETRIES)


def _replacements(cls: str, root: Node, limits: Limits, catalog: Catalog, rng: random.Random) -> list[tuple]:
    """(path, maker of the new subtree) of each place the class can change."""
    sampler = Sampler(rng, limits, catalog)
    out: list[tuple] = []
    for e in paths(root, catalog):
        step = e.path[-1] if e.path else None
        owner = subtree_at(root, e.path[:-1]) if e.path else None
        op = catalog.operator(owner.name) if owner is not None else None
        window = op is not None and isinstance(step, int) and _is_window(op.input(step))
        make: Callable[[], Node | None] | None = None
        if cls == "field" and e.node.tag == "field":
            others = [f.name for f in catalog.fields if f.name != e.node.name]
            make = (lambda o=others: ast.field(rng.choice(o))) if others else None
        elif cls == "window" and window:
            others = [w for w in windows_of(op.input(step), limits) if w != e.node.value]
            make = (lambda o=others: ast.number(float(rng.choice(o)))) if others else None
        elif cls == "scalar" and e.node.tag == "number" and not window and isinstance(step, int):
            make = lambda: sampler.scalar(nonzero=True)
        elif cls == "group" and e.node.tag == "group":
            others = [g for g in catalog.groups if g != e.node.name]
            make = (lambda o=others: ast.group(rng.choice(o))) if others else None
        elif cls == "bounded_keyword" and isinstance(step, str):
            spec = next((k for k in op.keywords if k.name == step), None)
            above = max((owner.keyword(a).value for a, b in op.less_than if b == step), default=None)
            below = min((owner.keyword(b).value for a, b in op.less_than if a == step), default=None)
            make = (lambda s=spec, a=above, b=below: sampler.keyword(s, b, a)) if spec else None
        elif cls == "boolean_literal" and e.node.tag == "bool":
            make = lambda n=e.node: ast.boolean(not n.value)
        elif cls == "operator" and e.node.tag == "call":
            others = [o for o in catalog.operators if o.weight > 0 and o.name != e.node.name and _fits(o, e.node, catalog)]
            make = (lambda o=others, n=e.node: _renamed(rng.choice(o), n, catalog)) if others else None
        elif cls == "subtree" and e.path and not isinstance(step, str) and not window:
            make = lambda a=sorted(e.allowed): sampler.kind(rng.choice(a), rng.randint(1, 3))
        if make is not None:
            out.append((e.path, make))
    return out


def _renamed(op: Operator, node: Node, catalog: Catalog) -> Node | None:
    try:
        return build_call(catalog, op.name, node.args, dict(node.kwargs))
    except ValidationError:
        return None


def _fits(op: Operator, node: Node, catalog: Catalog) -> bool:
    return op.output == node.kind and _renamed(op, node, catalog) is not None


def _fallback(requested: str, seed: int, index: int, limits: Limits, catalog: Catalog) -> tuple[Node, Provenance]:
    node, p = sample(seed, index, limits, catalog, domain="fallback")
    return node, Provenance("fallback_generation", p.operation, (), requested, retry_count=RETRIES)


def _mutated(parent: Node, cls: str, rng: random.Random, limits: Limits, catalog: Catalog) -> tuple[Node, str, Node, Node] | None:
    places = _replacements(cls, parent, limits, catalog, rng)
    if not places:
        return None
    path, make = rng.choice(places)
    new = make()
    if new is None:
        return None
    try:
        child = replace_subtree(parent, path, new, catalog)
    except PathError:
        return None
    if canonical(child) == canonical(parent) or not valid(child, limits, catalog):
        return None
    return child, show(parent, path), subtree_at(parent, path), new


def mutate(parent: Node, seed: int, index: int, limits: Limits, catalog: Catalog, cls: str | None = None, applicable: bool = False) -> tuple[Node, Provenance]:
    """One change of a class drawn anew for each of up to 16 attempts; then a fresh formula, marked as fallback.

    ``cls`` fixes the class; ``applicable`` draws only among classes that succeed.
    """
    rng = rng_for("mutate", seed, index, cls or "", applicable)
    requested = cls or ""
    pool = [cls] if cls else list(MUTATIONS)
    if applicable and cls is None:
        pool = [c for c in MUTATIONS if _mutated(parent, c, rng_for("try", seed, index, c), limits, catalog) is not None]
    for attempt in range(RETRIES + 1):
        if not pool:
            break
        c = rng.choice(pool)
        requested = requested or MUTATIONS[c]
        done = _mutated(parent, c, rng, limits, catalog)
        if done is not None:
            child, at, old, new = done
            return child, Provenance("mutation", MUTATIONS[c], (fingerprint(parent),), None, at, fingerprint(old), fingerprint(new), attempt)
    return _fallback(MUTATIONS.get(cls, requested) if cls else requested, seed, index, limits, catalog)


def crossover(left: Node, right: Node, seed: int, index: int, limits: Limits, catalog: Catalog, same_path: bool = False) -> tuple[Node, Provenance]:
    """A subtree of ``right`` put where ``left`` has one of an accepted kind; with ``same_path`` at the same address."""
    rng = rng_for("crossover", seed, index, same_path)
    donors = [e for e in paths(right, catalog) if e.path]
    places = [e for e in paths(left, catalog) if e.path]
    for attempt in range(RETRIES + 1):
        if not donors or not places:
            break
        place = rng.choice(places)
        fit = [d for d in donors if d.node.kind in place.allowed and (not same_path or d.path == place.path)]
        if not fit:
            continue
        new = rng.choice(fit).node
        try:
            child = replace_subtree(left, place.path, new, catalog)
        except PathError:
            continue
        if canonical(child) not in (canonical(left), canonical(right)) and valid(child, limits, catalog):
            operation = "exact_path_crossover" if same_path else "typed_crossover"
            return child, Provenance("crossover", operation, (fingerprint(left), fingerprint(right)), None, show(left, place.path), fingerprint(place.node), fingerprint(new), attempt)
    return _fallback("exact_path_crossover" if same_path else "typed_crossover", seed, index, limits, catalog)


def _try(catalog: Catalog, name: str, *args: Node | None) -> Node | None:
    op = catalog.operator(name)
    if op is None or op.weight == 0 or any(a is None for a in args):
        return None
    try:
        return build_call(catalog, name, list(args))
    except ValidationError:
        return None


def _w(w: int) -> Node:
    return ast.number(float(w))


@lru_cache(maxsize=32)
def cover_drafts(limits: Limits, catalog: Catalog) -> dict[str, tuple[Node, ...]]:
    """Plain formulas by root: fields, pairs, unary and rolling operators over them, three windows each; unchecked."""
    fields = [ast.field(f.name) for f in catalog.fields]
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    span = sorted({limits.min_window, (limits.min_window + limits.max_window) // 2, limits.max_window})
    bases = [*fields, *(n for a, b in pairs for n in (_try(catalog, "multiply", a, b), _try(catalog, "add", a, b), _try(catalog, "subtract", a, b)) if n is not None)]
    out: list[Node | None] = list(bases)
    for op in catalog.operators:
        if op.weight == 0 or op.output != SIGNAL or op.keywords:
            continue
        if op.arity == (1, 1):
            out += [_try(catalog, op.name, base) for base in bases]
        elif op.shape == "binary" and _is_window(op.inputs[1]) and (allowed := windows_of(op.inputs[1], limits)):
            near = sorted({min(allowed, key=lambda x, t=t: abs(x - t)) for t in span})
            out += [_try(catalog, op.name, base, _w(w)) for base in bases for w in near]
        elif op.arity == (3, 3) and len(op.inputs) == 3 and _is_window(op.inputs[2]):
            allowed = windows_of(op.inputs[2], limits)
            out += [_try(catalog, op.name, a, b, _w(w)) for a, b in pairs for w in allowed[:1] + allowed[-1:]]
    by_root: dict[str, list[Node]] = {}
    for n in out:
        if n is not None:
            by_root.setdefault(n.operator or "field", []).append(n)
    return {k: tuple(v) for k, v in by_root.items()}


def _usable(nodes: Iterable[Node], limits: Limits, catalog: Catalog) -> Iterable[Node]:
    return (n for n in nodes if valid(n, limits, catalog) and analyze(n).rejection_reason is None)


@lru_cache(maxsize=32)
def cover_universe(limits: Limits, catalog: Catalog) -> dict[str, tuple[Node, ...]]:
    """The usable ones of ``cover_drafts``, one of each meaning, up to COVER_UNIVERSE; made once for a catalog and limits."""
    seen, kept = set(), {}
    for root, drafts in cover_drafts(limits, catalog).items():
        for n in _usable(drafts, limits, catalog):
            identity = analyze(n).semantic_fingerprint
            if identity not in seen and len(seen) < COVER_UNIVERSE:
                seen.add(identity)
                kept.setdefault(root, []).append(n)
    return {k: tuple(v) for k, v in kept.items()}


@lru_cache(maxsize=32)
def motifs(limits: Limits, catalog: Catalog) -> dict[str, tuple[Node, ...]]:
    """Statistics of fields over the short windows, by family: a statistic, bare or under one finishing operator.

    A statistic is an operator of a pair of fields of families that move together, or the spread of one price; what may
    finish it is any single-argument or rolling operator of the catalog that keeps the unit of its argument.
    """
    of = lambda family: [ast.field(f.name) for f in catalog.fields if f.family == family]
    price, liquid = of("price"), of("liquidity")
    spans = [w for w in MOTIF_WINDOWS if limits.min_window <= w <= limits.max_window]
    same = [(a, b) for i, a in enumerate(price) for b in price[i + 1 :]]
    across = [(a, b) for a in liquid for b in price]
    bare = {
        ("ts_cov", "across"): [_try(catalog, "ts_cov", a, b, _w(w)) for a, b in across for w in spans], ("ts_corr", "same"): [_try(catalog, "ts_corr", a, b, _w(w)) for a, b in same for w in spans],
        ("ts_std_dev", "alone"): [_try(catalog, "ts_std_dev", p, _w(w)) for p in price for w in spans],
    }
    out: dict[str, list[Node]] = {}
    for (name, over), nodes in bare.items():
        out[f"{name}/{over}"] = nodes
        for finish in FINISHERS:
            if finish == "abs":
                out[f"abs/{name}/{over}"] = [_try(catalog, finish, n) for n in nodes]
            else:
                out[f"{finish}/{name}/{over}"] = [_try(catalog, finish, n, _w(w)) for n in nodes for w in spans if w <= 10]
    return {k: tuple(_usable((n for n in v if n is not None), limits, catalog)) for k, v in out.items()}


def _in_turns(queues: dict[str, Iterable[Node]], seed: int, label: str) -> Iterable[Node]:
    """One of each queue in turn; queues and their items in an order drawn by hash."""
    order = sorted(queues, key=lambda k: (digest(f"{label}-queue:{seed}:{k}"), k))
    lists = [sorted(queues[k], key=lambda n, k=k: (digest(f"{label}:{seed}:{k}:{canonical(n)}"), canonical(n))) for k in order]
    return _turns(lists)


def _turns(lists: Iterable[Iterable[Node]]) -> Iterable[Node]:
    """The first of each, then the second of each, and so on; only as many are made as are taken."""
    left = [iter(x) for x in lists]
    while left:
        going = []
        for it in left:
            n = next(it, None)
            if n is not None:
                yield n
                going.append(it)
        left = going


def cover(policy: str, seed: int, limits: Limits, catalog: Catalog) -> list[tuple[Node, Provenance]]:
    """Up to 64 starting formulas that don't depend on data: ``fixed``, ``seeded_diverse`` or ``motif_diverse``."""
    if policy == "fixed":
        picked, operation = _turns(_usable(v, limits, catalog) for v in cover_drafts(limits, catalog).values()), COVERS[0]
    elif policy == "seeded_diverse":
        picked, operation = _in_turns(cover_universe(limits, catalog), seed, "cover"), COVERS[1]
    elif policy == "motif_diverse":
        by_root = cover_universe(limits, catalog)
        heads = [next(iter(_in_turns({k: v}, seed, "root"))) for k, v in sorted(by_root.items(), key=lambda kv: digest(f"root:{seed}:{kv[0]}")) if k != "field"]
        picked, operation = [*by_root.get("field", ()), *heads, *_in_turns(motifs(limits, catalog), seed, "motif")], COVERS[2]
    else:
        raise ValueError(f"unknown cover policy `{policy}`")
    seen, out = set(), []
    for n in picked:
        identity = analyze(n).semantic_fingerprint
        if identity not in seen:
            seen.add(identity)
            out.append((n, Provenance("initial", operation)))
        if len(out) == COVER_SIZE:
            break
    return out
