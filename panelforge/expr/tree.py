"""Addresses of subtrees, and replacing them under the catalog's rules."""

from __future__ import annotations

from dataclasses import dataclass

from panelforge.expr.ast import BINARY, SCALAR, UNARY, Node
from panelforge.expr.catalog import Catalog, ValidationError, build_call, builtin, is_checked

#: A path is a tuple of steps: the number of an argument, or the name of a keyword.
Path = tuple[int | str, ...]


class PathError(ValueError):
    pass


def show(root: Node, path: Path) -> str:
    """``$.arg``, ``.left``, ``.right``, ``.args[i]`` and ``.kwargs.name``."""
    out, node = "$", root
    for step in path:
        if isinstance(step, str):
            out += f".kwargs.{step}"
        elif node.shape == UNARY:
            out += ".arg"
        elif node.shape == BINARY:
            out += (".left", ".right")[step]
        else:
            out += f".args[{step}]"
        node = _child(root, node, step, path)
    return out


def _child(root: Node, node: Node, step: int | str, path: Path) -> Node:
    if node.tag == "call":
        if isinstance(step, str):
            found = node.keyword(step)
            if found is not None:
                return found
        elif 0 <= step < len(node.args):
            return node.args[step]
    raise PathError(f"no such path: {path}")


def subtree_at(root: Node, path: Path) -> Node:
    node = root
    for step in path:
        node = _child(root, node, step, path)
    return node


@dataclass(frozen=True)
class Entry:
    path: Path
    node: Node
    allowed: frozenset[str]


def paths(root: Node, catalog: Catalog | None = None) -> list[Entry]:
    """Every subtree with the kinds its place accepts: the root's own kind, an argument's kinds, scalar for keywords.

    The list is kept with the tree, which never changes; don't alter it.
    """
    catalog = catalog or builtin()
    known = root.__dict__.get("_paths")
    if known is not None and known[0] is catalog:
        return known[1]
    out: list[Entry] = []

    def visit(node: Node, path: Path, allowed: frozenset[str]) -> None:
        out.append(Entry(path, node, allowed))
        if node.tag != "call":
            return
        op = catalog.operator(node.name)
        for i, a in enumerate(node.args):
            visit(a, (*path, i), frozenset(op.input(i).kinds) if op else frozenset([a.kind]))
        for k, v in node.kwargs:
            visit(v, (*path, k), frozenset([SCALAR]))

    visit(root, (), frozenset([root.kind]))
    root.__dict__["_paths"] = (catalog, out)
    return out


def allowed_kinds(root: Node, path: Path, catalog: Catalog | None = None) -> frozenset[str]:
    subtree_at(root, path)
    return next(e.allowed for e in paths(root, catalog) if e.path == path)


def replace_subtree(root: Node, path: Path, new: Node, catalog: Catalog | None = None) -> Node:
    """``root`` with ``new`` at ``path``; PathError if the place doesn't accept its kind or a rule is broken above it."""
    catalog = catalog or builtin()
    allowed = allowed_kinds(root, path, catalog)
    if new.kind not in allowed:
        raise PathError(f"{show(root, path)} accepts {sorted(allowed)}, got {new.kind}")

    def rebuild(node: Node, rest: Path) -> Node:
        if not rest:
            return new
        step = rest[0]
        child = rebuild(_child(root, node, step, path), rest[1:])
        args = tuple(child if i == step else a for i, a in enumerate(node.args))
        kwargs = {k: child if k == step else v for k, v in node.kwargs}
        return build_call(catalog, node.name, args, kwargs)

    try:
        return revalidated(rebuild(root, path), catalog)
    except ValidationError as e:
        raise PathError(f"the replacement at {show(root, path)} breaks a rule: {e}") from e


def revalidated(node: Node, catalog: Catalog) -> Node:
    """The same tree, every call that wasn't built under this catalog checked against it."""
    if is_checked(node, catalog):
        return node
    return build_call(catalog, node.name, [revalidated(a, catalog) for a in node.args], {k: revalidated(v, catalog) for k, v in node.kwargs})
