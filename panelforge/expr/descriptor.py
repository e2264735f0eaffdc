"""Structural descriptors of formulas and the distance between them."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.expr.ast import BINARY, UNARY, Node
from panelforge.expr.canonical import canonical, digest
from panelforge.expr.catalog import Catalog, builtin

# Operators that make a formula non-linear or conditional, and those whose last argument is a window.
NONLINEAR = frozenset({"rank", "zscore", "ts_rank", "ts_std_dev", "ts_var", "ts_skew", "ts_kurt", "ts_min", "ts_max", "ts_median", "ts_mad", "ts_cov", "ts_corr", "ts_zscore", "winsorize", "clip", "group_rank"})
CONDITIONAL = frozenset(["if_else", "greater"])
WINDOWED = frozenset({"ts_rank", "ts_mean", "ts_sum", "ts_std_dev", "ts_var", "ts_skew", "ts_kurt", "ts_min", "ts_max", "ts_median", "ts_mad", "ts_wma", "ts_ema", "ts_zscore", "ts_delta", "ts_delay", "ts_cov", "ts_corr"})

# Weights of the parts of the distance.
WEIGHTS = {
    "operator_shingles": 0.24, "operator_histogram": 0.14, "ordered_paths": 0.16, "fields": 0.08, "field_families": 0.10, "window_buckets": 0.08,
    "groups": 0.05, "flags": 0.10, "lineage_parents": 0.05,
}
_SETS = ("operator_shingles", "ordered_paths", "fields", "field_families", "groups", "lineage_parents")
_COUNTS = ("operator_histogram", "window_buckets")


@dataclass(frozen=True)
class Descriptor:
    operator_shingles: tuple[str, ...] = ()
    operator_histogram: dict[str, int] = field(default_factory=dict)
    ordered_paths: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    field_families: tuple[str, ...] = ()
    window_buckets: dict[str, int] = field(default_factory=dict)
    groups: tuple[str, ...] = ()
    nonlinear: bool = False
    conditional: bool = False
    lineage_parents: tuple[str, ...] = ()

    def to_dict(self) -> dict:
        return asdict(self)

    @property
    def signature(self) -> str:
        return digest(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")))


def window_bucket(value: float) -> str:
    return "short" if value <= 10 else "medium" if value <= 60 else "long"


def describe(root: Node, parents: Iterable[str] = (), catalog: Catalog | None = None) -> Descriptor:
    catalog = catalog or builtin()
    shingles, paths, fields, families, groups = set(), set(), set(), set(), set()
    operators: Counter = Counter()
    windows: Counter = Counter()
    todo: list[tuple[Node, str, str | None]] = [(root, "$", None)]
    while todo:
        node, path, above = todo.pop()
        if node.tag == "call":
            operators[node.name] += 1
            paths.add(f"{path}:{node.name}")
            if above is not None:
                shingles.add(f"{above}>{node.name}")
            if node.name in WINDOWED and node.args[-1].tag == "number":
                windows[window_bucket(node.args[-1].value)] += 1
            steps = {UNARY: ["arg"], BINARY: ["left", "right"]}.get(node.shape) or [f"arg{i}" for i in range(len(node.args))]
            todo += [(a, f"{path}.{s}", node.name) for a, s in zip(node.args, steps)]
            todo += [(v, f"{path}.kw.{k}", node.name) for k, v in node.kwargs]
        elif node.tag == "field":
            fields.add(node.name)
            spec = catalog.field(node.name)
            families.add(spec.family if spec else f"public:{node.name}")
            paths.add(f"{path}:field")
        elif node.tag == "group":
            groups.add(node.name)
            paths.add(f"{path}:group")
        else:
            paths.add(f"{path}:{canonical(node)}")
    names = set(operators)
    return Descriptor(
        *map(tuple, [sorted(shingles)]), dict(sorted(operators.items())), tuple(sorted(paths)), tuple(sorted(fields)), tuple(sorted(families)), dict(sorted(windows.items())), tuple(sorted(groups)),
        bool(names & NONLINEAR), bool(names & CONDITIONAL), tuple(sorted(set(parents))),
    )


def _jaccard(a, b) -> float:
    a, b = set(a), set(b)
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


def _histogram(a: dict, b: dict) -> float:
    keys = set(a) | set(b)
    total = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(abs(a.get(k, 0) - b.get(k, 0)) for k in keys) / total if total else 0.0


def distance(a: Descriptor, b: Descriptor) -> float:
    """0 for alike, 1 for nothing in common: the weighted mean of set, count and flag differences."""
    parts = {n: _jaccard(getattr(a, n), getattr(b, n)) for n in _SETS} | {n: _histogram(getattr(a, n), getattr(b, n)) for n in _COUNTS}
    parts["flags"] = ((a.nonlinear != b.nonlinear) + (a.conditional != b.conditional)) / 2
    return min(1.0, max(0.0, sum(WEIGHTS[n] * parts[n] for n in WEIGHTS)))


def shares_ancestor(a: Descriptor, b: Descriptor) -> int:
    return int(bool(set(a.lineage_parents) & set(b.lineage_parents)))


def distance_column(a: Column | str, b: Column | str) -> Column:
    """``distance`` between two descriptor structs, within the JVM. Null parts count as empty, flags as false."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def sets(n: str) -> Column:
        x, y = (F.array_distinct(F.filter(F.coalesce(s.getField(n), F.array().cast("array<string>")), lambda v: v.isNotNull())) for s in (a, b))
        union = F.size(F.array_union(x, y))
        return F.when(union > 0, F.lit(1.0) - F.size(F.array_intersect(x, y)) / union).otherwise(0.0)

    def counts(n: str) -> Column:
        x, y = (F.coalesce(s.getField(n), F.create_map().cast("map<string,int>")) for s in (a, b))
        at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
        keys = F.array_union(F.map_keys(x), F.map_keys(y))
        both = F.aggregate(
            keys, F.struct(F.lit(0).alias("total"), F.lit(0).alias("apart")),
            lambda s, k: F.struct((s["total"] + F.greatest(at(x, k), at(y, k))).alias("total"), (s["apart"] + F.abs(at(x, k) - at(y, k))).alias("apart")),
        )
        return F.when(both["total"] > 0, both["apart"] / both["total"]).otherwise(0.0)

    flag = lambda n: (F.coalesce(a.getField(n), F.lit(False)) != F.coalesce(b.getField(n), F.lit(False))).cast("int")
    parts = {n: sets(n) for n in _SETS} | {n: counts(n) for n in _COUNTS} | {"flags": (flag("nonlinear") + flag("conditional")) / 2}
    total = F.lit(0.0)
    for n, w in WEIGHTS.items():
        total = total + F.lit(w) * parts[n]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
