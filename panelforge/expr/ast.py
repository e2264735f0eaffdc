"""Immutable formula trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

SIGNAL, SCALAR, BOOLEAN, GROUP = "signal", "scalar", "boolean", "group"
KINDS = (SIGNAL, SCALAR, BOOLEAN, GROUP)

#: How the arguments of a call are addressed: one, two, or a list.
UNARY, BINARY, LIST = "unary", "binary", "list"


@dataclass(frozen=True)
class Node:
    """A field, number, truth value, group name or operator call.

    ``tag`` is field, number, bool, group or call; ``name`` the field, group or operator; ``value`` the literal.
    ``kwargs`` are sorted by name. ``shape`` says how a call's arguments are addressed.
    """

    tag: str
    name: str = ""
    value: float | bool | None = None
    args: tuple[Node, ...] = ()
    kwargs: tuple[tuple[str, Node], ...] = ()
    kind: str = SIGNAL
    shape: str = LIST

    @property
    def children(self) -> tuple[Node, ...]:
        """Arguments, then keyword values, which count as nodes of their own."""
        return (*self.args, *(v for _, v in self.kwargs))

    @property
    def operator(self) -> str | None:
        return self.name if self.tag == "call" else None

    @cached_property
    def node_count(self) -> int:
        return 1 + sum(c.node_count for c in self.children)

    @cached_property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children), default=0)

    @cached_property
    def operator_count(self) -> int:
        return (self.tag == "call") + sum(c.operator_count for c in self.children)

    def keyword(self, name: str) -> Node | None:
        return dict(self.kwargs).get(name)

    def with_parts(self, args: tuple[Node, ...], kwargs: tuple[tuple[str, Node], ...] | None = None) -> Node:
        return Node(self.tag, self.name, self.value, tuple(args), self.kwargs if kwargs is None else kwargs, self.kind, self.shape)

    def map_children(self, f) -> Node:
        if self.tag != "call":
            return self
        return self.with_parts(tuple(f(a) for a in self.args), tuple((k, f(v)) for k, v in self.kwargs))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


def field(name: str) -> Node:
    return Node("field", name)


def number(value: float) -> Node:
    value = float(value)
    return Node("number", value=value if value else 0.0, kind=SCALAR)


def boolean(value: bool) -> Node:
    return Node("bool", value=value, kind=BOOLEAN)


def group(name: str) -> Node:
    return Node("group", name, kind=GROUP)
