"""Semantic identity of formulas, and proofs that a formula is constant."""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass

from panelforge.expr.ast import LIST, SIGNAL, Node, number
from panelforge.expr.canonical import canonical, digest


def simplify(node: Node) -> Node:
    """Exact identities at any depth: a rank of a rank is that rank; a conditional with one outcome is that outcome."""
    if node.tag != "call":
        return node
    inner = [simplify(a) for a in node.args]  # keyword values are literals
    if any(a is not b for a, b in zip(inner, node.args)):
        node = node.with_parts(tuple(inner))
    if node.operator == "rank" and not node.kwargs and node.args[0].operator == "rank" and not node.args[0].kwargs:
        return node.args[0]
    if node.operator == "if_else" and len(node.args) == 3:
        condition, yes, no = node.args
        if condition.tag == "bool":
            return yes if condition.value else no
        if canonical(yes) == canonical(no):
            return yes
    return node


def normal_form(node: Node) -> Node:
    """What stands for all formulas equal but for a positive factor of the whole.

    After ``simplify``, at the root only: a sum of equal addends is the addend; in a product or quotient by scalars a
    positive scale is dropped and of a negative one a single -1 is kept.
    """
    node = simplify(node)
    addend = _common_addend(node)
    if addend is not None:
        return normal_form(addend)
    if node.operator in ("multiply", "divide"):
        parts = _root_product(node)
        if parts is not None:
            scale, factors = parts
            if math.isfinite(scale) and scale != 0:
                sole = normal_form(factors[0]) if len(factors) == 1 else None
                if scale > 0:
                    return sole if sole is not None else _product(factors)
                return _product([number(-1.0), sole]) if sole is not None else _product([*factors, number(-1.0)])
    return node


def _product(factors: list[Node]) -> Node:
    return Node("call", "multiply", None, tuple(factors), (), SIGNAL, LIST)


def _common_addend(node: Node) -> Node | None:
    """The addend that all addends equal: of the sum itself, else of the sum with nested sums opened up."""
    if node.operator != "add":
        return None
    opened, todo = [], list(reversed(node.args))
    while todo:
        n = todo.pop()
        if n.operator == "add":
            todo.extend(reversed(n.args))
        else:
            opened.append(n)
    for addends in (node.args, opened):
        if len(addends) >= 2 and len({canonical(a) for a in addends}) == 1:
            return addends[0]
    return None


def _root_product(node: Node) -> tuple[float, list[Node]] | None:
    """(scale, other factors) of nested products and quotients by literals; None if a quotient is by something else."""
    if node.tag == "number":
        return node.value, []
    if node.operator == "multiply":
        scale, factors = 1.0, []
        for a in node.args:
            part = _root_product(a)
            if part is None:
                return None
            scale *= part[0]
            factors += part[1]
        return scale, factors
    if node.operator == "divide":
        part = _root_product(node.args[0])
        if part is None or node.args[1].tag != "number" or node.args[1].value == 0:
            return None
        return part[0] / node.args[1].value, part[1]
    return 1.0, [node]


class Fact(enum.IntEnum):
    """What can be proved of a signal: nothing, that it is constant, or that it is zero (wherever present)."""

    UNKNOWN = 0
    CONSTANT = 1
    ZERO = 2


# How operators carry facts about their first argument.
_KEEPS = {"divide", "ts_delay", "ts_ema", "ts_max", "ts_mean", "ts_median", "ts_min", "ts_sum", "ts_wma"}
_TO_ZERO = {"ts_delta", "ts_mad", "ts_std_dev", "ts_var", "ts_zscore"}
_TO_CONSTANT = {"ts_rank", "group_rank"}
_ZERO_STAYS = {"abs", "negate", "sign", "winsorize"}


def fact(node: Node) -> Fact:
    if node.tag == "field":
        return Fact.UNKNOWN
    if node.tag != "call":
        return Fact.CONSTANT
    name, args = node.name, node.args
    if node.shape == "unary":
        f = fact(args[0])
        if f is Fact.ZERO:
            if name in _ZERO_STAYS:
                return f
            lower, upper = node.keyword("lower"), node.keyword("upper")
            if name == "clip" and lower is not None and upper is not None and lower.value <= 0 <= upper.value:
                return f
        return min(f, Fact.CONSTANT)
    if name == "if_else" and len(args) == 3:
        if args[0].tag == "bool":
            return fact(args[1] if args[0].value else args[2])
        if canonical(args[1]) == canonical(args[2]):
            return fact(args[1])
        return Fact.ZERO if fact(args[1]) is fact(args[2]) is Fact.ZERO else Fact.UNKNOWN
    if name == "multiply":
        facts = [fact(a) for a in args]
        if Fact.ZERO in facts or any(a.tag == "number" and a.value == 0 for a in args):
            return Fact.ZERO
        signals = [f for f, a in zip(facts, args) if a.kind == SIGNAL] if node.shape == LIST else facts
        return Fact.CONSTANT if all(f is Fact.CONSTANT for f in signals) else Fact.UNKNOWN
    if name == "subtract" and canonical(args[0]) == canonical(args[1]):
        return Fact.ZERO
    if name in ("add", "subtract"):
        return min(fact(a) for a in args)
    if node.shape == "binary":
        f = fact(args[0])
        if name in _KEEPS or f is Fact.UNKNOWN:
            return f if name in _KEEPS else Fact.UNKNOWN
        if name in _TO_ZERO:
            return Fact.ZERO
        if name in _TO_CONSTANT:
            return Fact.CONSTANT
    return Fact.UNKNOWN


REASONS = {Fact.ZERO: "provably_zero", Fact.CONSTANT: "provably_constant", Fact.UNKNOWN: None}


@dataclass(frozen=True)
class Analysis:
    semantic_canonical: str
    semantic_fingerprint: str
    rejection_reason: str | None


def analyze(node: Node) -> Analysis:
    text = canonical(normal_form(node))
    return Analysis(text, digest(text), REASONS[fact(node)])


def semantic_fingerprint(node: Node) -> str:
    return analyze(node).semantic_fingerprint
