"""Text to checked formula trees."""

from __future__ import annotations

import math
import re

from panelforge.expr import ast
from panelforge.expr.ast import SIGNAL, Node
from panelforge.expr.catalog import Catalog, ValidationError, build_call, builtin


class FormulaSyntaxError(ValueError):
    """``offset`` is in bytes of the UTF-8 text."""

    def __init__(self, text: str, at: int, message: str):
        self.offset = len(text[:at].encode("utf-8"))
        super().__init__(f"syntax error at byte {self.offset}: {message}")


class NonSignalRoot(ValueError):
    pass


_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)
      |(?P<number>(?:[0-9]|[+-](?=[0-9.]))[0-9]*(?:\.[0-9]*)?(?:[eE][+-]?[0-9]*)?)
      |(?P<text>"[^"]*")|(?P<mark>[(),=])""",
    re.VERBOSE,
)


class _Tokens:
    """The text as (kind, text, place) tokens, one ahead."""

    def __init__(self, text: str):
        self.text, self.items, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or not m.group():
                self.items.append(("bad", text[at], at))
                break
            if m.lastgroup != "space":
                self.items.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.items.append(("end", "", len(text)))
        self.i = 0

    @property
    def now(self) -> tuple[str, str, int]:
        return self.items[self.i]

    def next_is(self, mark: str, ahead: int = 0) -> bool:
        j = min(self.i + ahead, len(self.items) - 1)
        return self.items[j][:2] == ("mark", mark)

    def take(self) -> tuple[str, str, int]:
        t = self.items[self.i]
        self.i = min(self.i + 1, len(self.items) - 1)
        return t

    def fail(self, message: str, at: int | None = None) -> FormulaSyntaxError:
        return FormulaSyntaxError(self.text, self.now[2] if at is None else at, message)


def parse(text: str, catalog: Catalog | None = None) -> Node:
    """The checked tree of a formula whose root is a signal.

    FormulaSyntaxError, ValidationError (unknown names, arity, kinds, domains) or NonSignalRoot say what is wrong.
    """
    tokens = _Tokens(text)
    node = _expression(tokens, catalog or builtin())
    if tokens.now[0] != "end":
        raise tokens.fail("unexpected trailing input")
    if node.kind != SIGNAL:
        raise NonSignalRoot(f"a formula must produce a signal, not a {node.kind}")
    return node


def _expression(t: _Tokens, catalog: Catalog) -> Node:
    kind, text, at = t.now
    if kind == "number":
        t.take()
        return _number(t, text, at)
    if kind != "name":
        raise t.fail("expected a name or a scalar literal" if kind != "end" else "expected an expression")
    t.take()
    if not t.next_is("("):
        if text in ("true", "false"):
            return ast.boolean(text == "true")
        if catalog.field(text) is None:
            raise ValidationError(f"unknown field `{text}` in the active catalog")
        return ast.field(text)
    t.take()
    return _group(t, catalog) if text == "group" else _call(t, catalog, text)


def _number(t: _Tokens, text: str, at: int) -> Node:
    mantissa, _, exponent = text.lower().partition("e")
    if not any(c.isdigit() for c in mantissa):
        raise t.fail("invalid scalar literal", at)
    if "e" in text.lower() and not any(c.isdigit() for c in exponent):
        raise t.fail("invalid scalar exponent", at)
    value = float(text)
    if not math.isfinite(value):
        raise t.fail("a scalar literal must be finite", at)
    return ast.number(value)


def _group(t: _Tokens, catalog: Catalog) -> Node:
    kind, text, at = t.take()
    if kind != "text":
        raise t.fail("a group literal must be a quoted string", at)
    name = text[1:-1]
    if not t.next_is(")"):
        raise t.fail("expected `)` after a group literal")
    t.take()
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise t.fail("a group name has only letters, digits or `_`", at)
    if not catalog.has_group(name):
        raise ValidationError(f"unknown group `{name}` in the active catalog")
    return ast.group(name)


def _call(t: _Tokens, catalog: Catalog, name: str) -> Node:
    args: list[Node] = []
    kwargs: dict[str, Node] = {}
    while not t.next_is(")"):
        keyword = None
        if t.now[0] == "name" and t.next_is("=", 1):
            keyword = t.take()[1]
            t.take()
        at = t.now[2]
        value = _expression(t, catalog)
        if keyword is None:
            if kwargs:
                raise t.fail("a positional argument can't follow a keyword argument", at)
            args.append(value)
        elif keyword in kwargs:
            raise t.fail(f"duplicate keyword `{keyword}`", at)
        else:
            kwargs[keyword] = value
        if t.next_is(","):  # one may stand before the closing bracket
            t.take()
        elif not t.next_is(")"):
            raise t.fail("expected `,` or `)`")
    t.take()
    return build_call(catalog, name, args, kwargs)
