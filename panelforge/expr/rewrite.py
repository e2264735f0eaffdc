"""Opt-in rewrites: unit scaling, and lowering to a target dialect."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from panelforge.expr.ast import LIST, SIGNAL, Node, number
from panelforge.expr.canonical import canonical
from panelforge.expr.catalog import Catalog
from panelforge.expr.parser import parse


def reduce_unit_scaling(node: Node) -> Node:
    """Drops multiplications and divisions by exactly 1, at any depth, where a signal remains. No other change."""
    node = node.map_children(reduce_unit_scaling)
    if node.operator not in ("multiply", "divide") or node.kwargs or node.kind != SIGNAL:
        return node
    one = [a.tag == "number" and a.value == 1.0 for a in node.args]
    if node.operator == "divide":
        rest = node.args[:1] if one[1] else ()
    else:
        rest = tuple(a for a, o in zip(node.args, one) if not o)
    return rest[0] if len(rest) == 1 and len(rest) < len(node.args) and rest[0].kind == SIGNAL else node


class DialectError(ValueError):
    pass


@dataclass(frozen=True)
class Dialect:
    """What a target system understands, and unary operators to write as replacement(scalar, argument)."""

    name: str
    allowed_operators: frozenset[str]
    allowed_fields: frozenset[str]
    lowerings: dict[str, tuple[str, float]] = field(default_factory=dict)

    def validated(self) -> Dialect:
        if not self.name.strip() or not self.allowed_operators or not self.allowed_fields:
            raise DialectError("a dialect needs a name, operators and fields")
        for source, (replacement, scalar) in self.lowerings.items():
            if not source.strip() or replacement not in self.allowed_operators or not math.isfinite(scalar):
                raise DialectError(f"invalid lowering of `{source}`")
        return self

    @staticmethod
    def from_json(text: str) -> Dialect:
        d = json.loads(text)
        if d.get("schema") != 1:
            raise DialectError(f"unsupported dialect schema {d.get('schema')}")
        low = {k: (v["replacement"], float(v["scalar"])) for k, v in d.get("unary_scalar_lowerings", {}).items()}
        return Dialect(d["name"], frozenset(d["allowed_operators"]), frozenset(d["allowed_fields"]), low).validated()


@dataclass(frozen=True)
class Compiled:
    dialect: str
    source_expression: str
    compiled_expression: str
    lowerings_applied: tuple[str, ...]
    operators: tuple[str, ...]
    fields: tuple[str, ...]


def compile_dialect(text: str, dialect: Dialect, catalog: Catalog | None = None) -> Compiled:
    """The formula in the target's terms; DialectError if a name isn't allowed there. Nothing is emitted in part."""
    dialect.validated()
    source = parse(text, catalog)
    applied: list[str] = []

    def lower(n: Node) -> Node:
        n = n.map_children(lower)
        if n.operator in dialect.lowerings and n.shape == "unary":
            if n.kwargs or n.kind != SIGNAL:
                raise DialectError(f"invalid lowering of `{n.name}`")
            replacement, scalar = dialect.lowerings[n.name]
            applied.append(f"{n.name}->{replacement}")
            return Node("call", replacement, None, (number(scalar), *n.args), (), SIGNAL, LIST)
        return n

    out = lower(source)
    operators = sorted({n.name for n in out.walk() if n.tag == "call"})
    fields = sorted({n.name for n in out.walk() if n.tag == "field"})
    for what, names, allowed in (("operator", operators, dialect.allowed_operators), ("field", fields, dialect.allowed_fields)):
        for n in names:
            if n not in allowed:
                raise DialectError(f"the target dialect does not allow {what} `{n}`")
    return Compiled(dialect.name, canonical(source), canonical(out), tuple(applied), tuple(operators), tuple(fields))
