"""One text for each formula, and fingerprints."""

from __future__ import annotations

import hashlib
from decimal import Decimal
from functools import cache

from panelforge.expr.ast import Node
from panelforge.expr.catalog import builtin


def scalar_text(value: float) -> str:
    """The shortest digits that read back as ``value``, never with an exponent; zero is 0."""
    if value == 0:
        return "0"
    text = format(Decimal(repr(float(value))), "f")
    return text[:-2] if text.endswith(".0") else text


def canonical(node: Node) -> str:
    """Keywords sorted by name, arguments of commutative built-in operators by their text."""
    text = node.__dict__.get("_canonical")
    if text is None:
        text = node.__dict__["_canonical"] = _written(node)  # trees never change, and are shared between formulas
    return text


def _written(node: Node) -> str:
    if node.tag == "number":
        return scalar_text(node.value)
    if node.tag == "bool":
        return "true" if node.value else "false"
    if node.tag == "group":
        return f'group("{node.name}")'
    if node.tag == "field":
        return node.name
    args = [canonical(a) for a in node.args]
    if commutes(node.name):
        args.sort()
    return f"{node.name}({', '.join([*args, *(f'{k}={canonical(v)}' for k, v in node.kwargs)])})"


@cache
def commutes(operator: str) -> bool:
    """Whether a built-in operator gives the same in any order of its arguments."""
    known = builtin().operator(operator)
    return known is not None and known.commutative


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def fingerprint(node: Node) -> str:
    return digest(canonical(node))
