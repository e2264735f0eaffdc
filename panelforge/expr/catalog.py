"""Catalogs: which operators, fields and groups formulas may use, and how."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field
from functools import cache, cached_property

from panelforge.expr.ast import BINARY, BOOLEAN, GROUP, KINDS, LIST, SCALAR, SIGNAL, UNARY, Node


class CatalogError(ValueError):
    pass


class ValidationError(ValueError):
    pass


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


@dataclass(frozen=True)
class Input:
    """Kinds an argument may have; domain: None, ("window", lo, hi), ("window_set", values) or ("non_zero_scalar",)."""

    kinds: tuple[str, ...]
    domain: tuple | None = None

    def problem(self, value: Node) -> str | None:
        if self.domain is None:
            return None
        what = self.domain[0]
        x = value.value if value.tag == "number" else None
        if what == "non_zero_scalar":
            return None if x is not None and x != 0 else "a number other than 0 is wanted"
        if what == "window":
            good = x is not None and x == int(x) and self.domain[1] <= x <= self.domain[2]
            return None if good else f"a whole window from {self.domain[1]} to {self.domain[2]} is wanted"
        return None if x is not None and x in self.domain[1] else "not one of the listed windows"


@dataclass(frozen=True)
class Keyword:
    name: str
    min: float
    max: float
    step: float
    required: bool = True


@dataclass(frozen=True)
class Operator:
    """``arity``: (least, most) arguments; ``inputs`` has one entry per argument, or one for all of a variadic."""

    name: str
    shape: str
    arity: tuple[int, int]
    inputs: tuple[Input, ...]
    output: str
    required_kinds: tuple[str, ...] = ()
    commutative: bool = False
    associative: bool = False
    keywords: tuple[Keyword, ...] = ()
    less_than: tuple[tuple[str, str], ...] = ()
    weight: int = 1
    parse_only_reason: str | None = None
    variadic: bool = False

    def input(self, i: int) -> Input:
        return self.inputs[0] if self.variadic else self.inputs[i]


@dataclass(frozen=True)
class FieldSpec:
    name: str
    family: str
    roles: tuple[str, ...]
    kind: str = SIGNAL


@dataclass(frozen=True)
class Catalog:
    name: str
    operators: tuple[Operator, ...]
    fields: tuple[FieldSpec, ...]
    groups: tuple[str, ...]
    scalar_domain: tuple[float, float, float] = (-100.0, 100.0, 1.0)
    group_kinds: tuple[str, ...] = field(default=())

    @cached_property
    def _ops(self) -> dict[str, Operator]:
        return {o.name: o for o in self.operators}

    @cached_property
    def _fields(self) -> dict[str, FieldSpec]:
        return {f.name: f for f in self.fields}

    def operator(self, name: str) -> Operator | None:
        return self._ops.get(name)

    def field(self, name: str) -> FieldSpec | None:
        return self._fields.get(name)

    def has_group(self, name: str) -> bool:
        return name in self.groups

    def validated(self) -> Catalog:
        """Itself, or CatalogError at the first thing wrong."""

        def fail(condition: bool, message: str) -> None:
            if condition:
                raise CatalogError(message)

        fail(not (self.operators and self.fields and self.groups), "operators, fields and groups must not be empty")
        fail(not _domain_ok(*self.scalar_domain), "the scalar grid needs finite bounds in order and a positive step")
        for label, names in (("operator", [o.name for o in self.operators]), ("field", [f.name for f in self.fields]), ("group", list(self.groups))):
            for n in names:
                fail(not _NAME.match(n) or names.count(n) > 1, f"`{n}` can't name one {label} alone: not an identifier, or taken")
        for f in self.fields:
            fail(f.kind != SIGNAL or not f.family or not f.roles, f"`{f.name}` must be a signal with a family and roles")
        fail(any(k != GROUP for k in self.group_kinds), "a group of another kind than group")
        for o in self.operators:
            fail(o.arity[0] < 1 or o.arity[0] > o.arity[1], f"`{o.name}`: the number of arguments is out of order")
            fail(len(o.inputs) != (1 if o.variadic else o.arity[0]) or any(not i.kinds or not set(i.kinds) <= set(KINDS) for i in o.inputs), f"`{o.name}`: arguments and their kinds don't match")
            for i in o.inputs:
                if i.domain and i.domain[0] == "window":
                    fail(i.domain[1] < 1 or i.domain[1] > i.domain[2], f"`{o.name}`: window bounds out of order")
                if i.domain and i.domain[0] == "window_set":
                    v = i.domain[1]
                    fail(not v or 0 in v or any(a >= b for a, b in zip(v, v[1:])), f"`{o.name}`: windows must be positive and ascend")
            fail(o.weight == 0 and o.parse_only_reason is None, f"`{o.name}` is never drawn and doesn't say why")
            names = [k.name for k in o.keywords]
            fail(any(not _NAME.match(n) or names.count(n) > 1 for n in names), f"`{o.name}`: a keyword is not an identifier, or taken")
            fail(any(not _domain_ok(k.min, k.max, k.step) for k in o.keywords), f"`{o.name}`: a keyword's grid needs finite bounds in order and a positive step")
            fail(any(a not in names or b not in names for a, b in o.less_than), f"`{o.name}` orders keywords it doesn't have")
        return self

    def to_json(self) -> str:
        return json.dumps(_to_dict(self), sort_keys=True, separators=(",", ":"))

    @staticmethod
    def from_json(text: str) -> Catalog:
        try:
            return _from_dict(json.loads(text)).validated()
        except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
            raise CatalogError(f"not a catalog: {e}") from e

    @cached_property
    def checksum(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()


def _domain_ok(lo: float, hi: float, step: float) -> bool:
    return all(map(math.isfinite, (lo, hi, step))) and lo < hi and step > 0


def _to_dict(c: Catalog) -> dict:
    def op(o: Operator) -> dict:
        if o.variadic:
            arity = {"kind": "variadic", "min": o.arity[0], "max": o.arity[1]}
        else:
            arity = {"kind": o.shape} if o.shape != LIST else {"kind": "exact", "count": o.arity[0]}

        def domain(d):
            if d[0] == "window":
                return {"kind": "window", "min": d[1], "max": d[2]}
            return {"kind": "window_set", "values": list(d[1])} if d[0] == "window_set" else {"kind": d[0]}

        return {
            "name": o.name, "arity": arity, "inputs": [{"kinds": list(i.kinds), **({"domain": domain(i.domain)} if i.domain else {})} for i in o.inputs], "required_input_kinds": list(o.required_kinds),
            "output": o.output, "commutative": o.commutative, "associative": o.associative, "keywords": [vars(k) for k in o.keywords],
            "keyword_constraints": [{"kind": "less_than", "left": a, "right": b} for a, b in o.less_than], "generation_weight": o.weight, "parse_only_reason": o.parse_only_reason,
        }

    return {
        "schema": 1, "name": c.name, "scalar_domain": dict(zip(("min", "max", "step"), c.scalar_domain)), "fields": [{"name": f.name, "kind": f.kind, "family": f.family, "allowed_roles": list(f.roles)} for f in c.fields],
        "groups": [{"name": g, "kind": "group"} for g in c.groups], "operators": [op(o) for o in c.operators],
    }


def _from_dict(d: dict) -> Catalog:
    if d["schema"] != 1:
        raise CatalogError(f"unsupported catalog schema {d['schema']}")

    def domain(x: dict | None) -> tuple | None:
        if not x or x["kind"] == "any":
            return None
        if x["kind"] == "window":
            return ("window", x["min"], x["max"])
        if x["kind"] == "window_set":
            return ("window_set", tuple(x["values"]))
        if x["kind"] == "non_zero_scalar":
            return ("non_zero_scalar",)
        raise CatalogError(f"unknown domain {x['kind']}")

    def op(x: dict) -> Operator:
        a = x["arity"]
        shape, arity = {"unary": (UNARY, (1, 1)), "binary": (BINARY, (2, 2))}.get(a["kind"], (LIST, (a.get("count", a.get("min", 0)), a.get("count", a.get("max", 0)))))
        return Operator(
            x["name"], shape, arity, tuple(Input(tuple(i["kinds"]), domain(i.get("domain"))) for i in x["inputs"]), x["output"], tuple(x.get("required_input_kinds") or ()),
            bool(x.get("commutative", False)), bool(x.get("associative", False)), tuple(Keyword(k["name"], k["min"], k["max"], k["step"], k.get("required", True)) for k in x.get("keywords") or ()),
            tuple((c["left"], c["right"]) for c in x.get("keyword_constraints") or ()), x["generation_weight"], x.get("parse_only_reason"), a["kind"] == "variadic",
        )

    s = d["scalar_domain"]
    return Catalog(
        d["name"], tuple(op(x) for x in d["operators"]), tuple(FieldSpec(f["name"], f["family"], tuple(f["allowed_roles"]), f["kind"]) for f in d["fields"]), tuple(g["name"] for g in d["groups"]),
        (s["min"], s["max"], s["step"]), tuple(g["kind"] for g in d["groups"]),
    )


# The built-in operators with their generation weights, window bounds and keyword grids.
_WINDOW = Input((SCALAR,), ("window", 2, 512))
_X = Input((SIGNAL,))
_UNARY_WEIGHTS = {"negate": 1, "abs": 1, "sign": 1, "rank": 2, "zscore": 2}
_ROLLING_WEIGHTS = {
    "ts_rank": 3, "ts_mean": 3, "ts_std_dev": 2, "ts_zscore": 3, "ts_delta": 3, "ts_delay": 2, "ts_sum": 2, "ts_var": 1, "ts_skew": 1, "ts_kurt": 1,
    "ts_min": 2, "ts_max": 2, "ts_median": 1, "ts_mad": 1, "ts_wma": 1, "ts_ema": 1,
}
_PAIR_WEIGHTS = {"ts_cov": 2, "ts_corr": 3}
_FAMILIES = {"close": "price", "open": "price", "high": "price", "low": "price", "volume": "liquidity", "returns": "return"}


@cache
def builtin() -> Catalog:
    """The built-in catalog: 32 operators, 6 fields, 3 groups, whole-numbered scalars from -100 to 100."""
    ops = [Operator(n, UNARY, (1, 1), (_X,), SIGNAL, weight=w) for n, w in _UNARY_WEIGHTS.items()]
    ops += [Operator(n, BINARY, (2, 2), (_X, _WINDOW), SIGNAL, weight=w) for n, w in _ROLLING_WEIGHTS.items()]
    ops += [Operator(n, LIST, (3, 3), (_X, _X, _WINDOW), SIGNAL, weight=w) for n, w in _PAIR_WEIGHTS.items()]
    ops += [
        Operator("subtract", BINARY, (2, 2), (_X, _X), SIGNAL, weight=2),
        Operator("divide", BINARY, (2, 2), (_X, Input((SCALAR,), ("non_zero_scalar",))), SIGNAL),
        Operator("greater", BINARY, (2, 2), (_X, Input((SCALAR,))), BOOLEAN, weight=2),
        Operator("group_rank", BINARY, (2, 2), (_X, Input((GROUP,))), SIGNAL, weight=2),
        Operator("add", LIST, (2, 8), (_X,), SIGNAL, (SIGNAL,), True, True, weight=2, variadic=True),
        Operator("multiply", LIST, (2, 8), (Input((SIGNAL, SCALAR)),), SIGNAL, (SIGNAL,), True, True, weight=2, variadic=True),
        Operator("if_else", LIST, (3, 3), (Input((BOOLEAN,)), _X, _X), SIGNAL, weight=2),
        Operator("winsorize", UNARY, (1, 1), (_X,), SIGNAL, keywords=(Keyword("std", 0.1, 10.0, 0.1),), weight=2),
        Operator("clip", UNARY, (1, 1), (_X,), SIGNAL, keywords=(Keyword("lower", -100.0, 100.0, 0.1), Keyword("upper", -100.0, 100.0, 0.1)), less_than=(("lower", "upper"),)),
    ]
    fields = tuple(FieldSpec(n, f, ("signal_input", "condition_input")) for n, f in _FAMILIES.items())
    return Catalog("builtin", tuple(ops), fields, ("sector", "industry", "country")).validated()


def build_call(catalog: Catalog, name: str, args: list[Node] | tuple[Node, ...], kwargs: dict[str, Node] | None = None) -> Node:
    """A call checked for arity, kinds, domains and keywords; ValidationError says what is wrong."""
    kwargs = kwargs or {}
    op = catalog.operator(name)
    if op is None:
        raise ValidationError(f"no operator `{name}` here")
    if not op.arity[0] <= len(args) <= op.arity[1]:
        raise ValidationError(f"`{name}` takes {op.arity[0]} to {op.arity[1]} arguments, not {len(args)}")
    for i, a in enumerate(args):
        spec = op.input(i)
        if a.kind not in spec.kinds:
            raise ValidationError(f"`{name}`, argument {i + 1}: a {a.kind} where one of {', '.join(spec.kinds)} is wanted")
        if problem := spec.problem(a):
            raise ValidationError(f"`{name}`, argument {i + 1}: {problem}")
    for k in op.required_kinds:
        if all(a.kind != k for a in args):
            raise ValidationError(f"`{name}` has no {k} among its arguments")
    known = {k.name: k for k in op.keywords}
    for k in op.keywords:
        if k.required and k.name not in kwargs:
            raise ValidationError(f"`{name}` lacks `{k.name}=`")
    for k, v in kwargs.items():
        if k not in known:
            raise ValidationError(f"`{name}` has no keyword `{k}`")
        if v.tag != "number":
            raise ValidationError(f"`{k}=` takes a number")
        if not known[k].min <= v.value <= known[k].max:
            raise ValidationError(f"`{k}=` is outside {known[k].min} to {known[k].max}")
    for a, b in op.less_than:
        if a not in kwargs or b not in kwargs:
            raise ValidationError(f"`{name}` compares `{a}` with `{b}`; give both")
        if kwargs[a].value >= kwargs[b].value:
            raise ValidationError(f"`{name}`: `{a}` isn't below `{b}`")
    node = Node("call", name, None, tuple(args), tuple(sorted(kwargs.items())), op.output, op.shape)
    if all(is_checked(a, catalog) for a in args):
        node.__dict__["_checked_by"] = catalog
    return node


def is_checked(node: Node, catalog: Catalog) -> bool:
    """Whether all calls of the tree were built under this very catalog."""
    return node.tag != "call" or node.__dict__.get("_checked_by") is catalog
