"""Formulas to DataFrames: shared subtrees become columns, added stage by stage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.expr.ast import SCALAR, SIGNAL, Node
from panelforge.expr.canonical import canonical
from panelforge.functions import cross, elementwise, kernels, rolling
from panelforge.operators.panel import KEYS, DatasetError, Panel
from panelforge.plans.lineage import cut

#: Window columns after which the plan is cut: wider or deeper plans cost more to plan than to run.
CUT_AFTER = 48

TIME, CROSS, PLAIN = "time", "cross", "plain"
_CROSS = {"rank", "zscore", "winsorize", "group_rank"}

#: The operators with an evaluation.
SUPPORTED = frozenset({*rolling.ROLLING, *rolling.PAIRED, *_CROSS, "negate", "abs", "sign", "add", "subtract", "multiply", "divide", "clip", "greater", "if_else"})


class UnsupportedOperator(ValueError):
    pass


def exact_key(node: Node) -> str:
    """Text that is equal only for trees that compute the same in the same order."""
    if node.tag != "call":
        return canonical(node)
    return f"{node.name}({','.join([*map(exact_key, node.args), *(f'{k}={exact_key(v)}' for k, v in node.kwargs)])})"


def axis(node: Node) -> str:
    if node.name in rolling.ROLLING or node.name in rolling.PAIRED:
        return TIME
    return CROSS if node.name in _CROSS else PLAIN


class _Plan:
    """Adds window results as columns. A window's inputs are plain expressions over columns that exist already."""

    def __init__(self, panel: Panel):
        self.panel, self.df = panel, panel.df
        self.columns: dict[str, str] = {}  # exact key of a window node -> its column
        self.windows_since_cut = 0

    def ready(self, node: Node) -> bool:
        """Whether the node can be written with the columns there are."""
        if node.tag != "call" or exact_key(node) in self.columns:
            return True
        return axis(node) == PLAIN and all(self.ready(c) for c in node.args)

    def column(self, node: Node) -> Column:
        """The node over existing columns; only for nodes that are ready, or windows whose arguments are."""
        if node.tag == "field":
            if node.name not in self.panel.fields:
                raise DatasetError(f"the dataset lacks field `{node.name}`")
            return F.col(f"`{node.name}`")
        if node.tag in ("number", "bool"):
            return F.lit(node.value)
        name = self.columns.get(exact_key(node))
        return F.col(name) if name else self._call(node)

    def _call(self, node: Node) -> Column:
        args, name = node.args, node.name
        if name in rolling.ROLLING:
            return rolling.ROLLING[name](self.column(args[0]), int(args[1].value))
        if name in rolling.PAIRED:
            return rolling.PAIRED[name](self.column(args[0]), self.column(args[1]), int(args[2].value))
        if name == "group_rank":
            if args[1].name not in self.panel.groups:
                raise DatasetError(f"the dataset lacks group `{args[1].name}`")
            return cross.rank(self.column(args[0]), f"grp_{args[1].name}")
        if name == "winsorize":
            return cross.winsorize(self.column(args[0]), node.keyword("std").value)
        if name == "clip":
            return elementwise.clip(self.column(args[0]), node.keyword("lower").value, node.keyword("upper").value)
        if name == "greater":
            return elementwise.greater(self.column(args[0]), args[1].value)
        if name in ("add", "multiply"):
            signals = [self.column(a) for a in args if a.kind == SIGNAL]
            scalars = [a.value for a in args if a.kind == SCALAR]
            return getattr(elementwise, name)(signals, scalars)
        cols = [self.column(a) for a in args]
        simple = {
            "rank": cross.rank, "zscore": cross.zscore, "negate": elementwise.negate, "abs": elementwise.absolute, "sign": elementwise.sign, "if_else": elementwise.if_else,
            "subtract": lambda a, b: a - b, "divide": lambda a, b: a / b,
        }
        if name not in simple:
            raise UnsupportedOperator(f"no evaluation of operator `{name}`")
        return simple[name](*cols)

    def stage(self, nodes: list[Node]) -> None:
        """One projection with the results of several windows of the same axis."""
        added, inputs, asked = {}, {}, {}
        for n in nodes:
            name = f"__w{len(self.columns)}"
            if n.name in kernels.KERNELS and n.args[1].value > kernels.SHORT:
                inputs[f"{name}_in"] = self.column(n.args[0]).cast("double")
                asked[name] = (n.name, f"{name}_in", int(n.args[1].value))
            else:
                added[name] = self._call(n).cast("double")
            self.columns[exact_key(n)] = name
        if added:
            self.df = self.df.withColumns(added)
        if asked:
            self.df = kernels.with_kernels(self.df.withColumns(inputs), asked).drop(*inputs)
        self.windows_since_cut += len(added)
        if self.windows_since_cut > CUT_AFTER:
            self.df = cut(self.df)
            self.windows_since_cut = 0


def compile_signals(panel: Panel, formulas: Mapping[str, Node], decay: int = 0) -> DataFrame:
    """t, ts, ai, asset, realized_returns and one column per formula.

    Equal subtrees of all formulas are computed once. Windows over time and windows across assets alternate as few times
    as their nesting allows: all that can be done over time is done before the next change to the other, because only a
    change of axis moves rows. Elementwise parts are fused into the projections of what uses them. ``decay``: linear decay
    of each root over that many rows; 0 for none.
    """
    if not 0 <= decay <= 512:
        raise ValueError("decay must be between 0 and 512")
    plan = _Plan(panel)
    waiting: dict[str, Node] = {}

    def gather(n: Node) -> None:
        for c in n.children:
            gather(c)
        if n.tag == "call":
            if n.name not in SUPPORTED:
                raise UnsupportedOperator(f"no evaluation of operator `{n.name}`")
            if axis(n) != PLAIN:
                waiting.setdefault(exact_key(n), n)

    for f in formulas.values():
        gather(f)
    turn = TIME
    while waiting:
        moved = False
        while True:
            now = [n for n in waiting.values() if axis(n) == turn and all(plan.ready(a) for a in n.args)]
            if not now:
                break
            for i in range(0, len(now), CUT_AFTER):
                plan.stage(now[i : i + CUT_AFTER])
            for n in now:
                del waiting[exact_key(n)]
            moved = True
        turn = CROSS if turn == TIME else TIME
        if not moved and not any(axis(n) == turn and all(plan.ready(a) for a in n.args) for n in waiting.values()):
            raise AssertionError("no window is ready")
    roots = {name: plan.column(f).cast("double").alias(name) for name, f in formulas.items()}
    out = plan.df.select(*KEYS, "realized_returns", *roots.values())
    if decay > kernels.SHORT:
        inputs = {f"__d{i}": name for i, name in enumerate(roots)}
        rolled = kernels.with_kernels(out, {k: ("decay", name, decay) for k, name in inputs.items()})
        return rolled.drop(*roots).withColumnsRenamed(inputs).select(*out.columns)
    if decay:
        out = out.withColumns({name: rolling.decay(F.col(f"`{name}`"), decay) for name in roots})
    return out
