"""Ask/tell sessions: the caller measures, the session proposes."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from panelforge.expr.analysis import analyze
from panelforge.expr.canonical import canonical
from panelforge.expr.catalog import Catalog, builtin
from panelforge.expr.descriptor import describe, distance
from panelforge.expr.parser import parse
from panelforge.search import transform
from panelforge.search.transform import Limits, Provenance, rng_for

PARENT_POLICIES = ("score", "uniform", "score_diverse_v1", "latest_batch_score_v1", "latest_batch_uniform_v1")
CHECKPOINT_BYTES, HISTORY_SIZE = 64 << 20, 100_000
_SHA = re.compile(r"[0-9a-f]{64}\Z")


class SessionError(ValueError):
    pass


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise SessionError(message)


@dataclass(frozen=True)
class SessionConfig:
    """``max_evaluations`` bounds the new proposals, measured or screened out; seeds and re-scored parents are free."""

    evaluator_context: str
    seed: int = 0
    limits: Limits = field(default_factory=Limits)
    max_evaluations: int = 100
    max_attempts: int = 10_000
    batch_size: int = 8
    parent_capacity: int = 16
    exploration_every: int = 4
    exploration_policy: str = "fixed_cover"
    mutation_policy: str = "legacy_uniform"
    parent_selection: str = "score"

    def checked(self) -> SessionConfig:
        self.limits.checked()
        _require(1 <= self.max_evaluations <= 100_000, "max_evaluations must be in 1..100000")
        _require(self.max_evaluations <= self.max_attempts <= 10_000_000, "max_attempts must cover the proposals and be at most 10000000")
        _require(1 <= self.batch_size <= 256 and 1 <= self.parent_capacity <= 256, "batch_size and parent_capacity must be in 1..256")
        _require(self.exploration_every >= 1, "exploration_every must be positive")
        _require(bool(self.evaluator_context.strip()) and len(self.evaluator_context.encode()) <= 4096, "evaluator_context must be non-blank and at most 4096 bytes")
        _require(self.exploration_policy in ("fixed_cover", "grammar"), "unknown exploration_policy")
        _require(self.mutation_policy in ("legacy_uniform", "applicable"), "unknown mutation_policy")
        _require(self.parent_selection in PARENT_POLICIES, "unknown parent_selection")
        return self

    @property
    def latest_batch(self) -> bool:
        return self.parent_selection.startswith("latest_batch")

    @staticmethod
    def from_dict(d: dict) -> SessionConfig:
        return SessionConfig(**{**d, "limits": Limits(**d.get("limits", {}))}).checked()


@dataclass(frozen=True)
class Proposal:
    ordinal: int
    expression: str
    semantic_fingerprint: str
    provenance: dict


@dataclass(frozen=True)
class ExcludedHistory:
    """Semantic fingerprints never to be proposed again, shared by sessions and checkpoints that refer to it."""

    entries: frozenset[str]

    def checked(self) -> ExcludedHistory:
        _require(len(self.entries) <= HISTORY_SIZE and all(_SHA.match(e) for e in self.entries), "a history has at most 100000 lower-case SHA-256 fingerprints")
        return self

    @property
    def checksum(self) -> str:
        return hashlib.sha256(json.dumps(sorted(self.entries)).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps(sorted(self.entries))

    @staticmethod
    def from_json(text: str) -> ExcludedHistory:
        return ExcludedHistory(frozenset(json.loads(text))).checked()


class Session:
    """State: proposals seen, measured parents, the pending batch, counters. Every ``ask`` is a function of it."""

    def __init__(self, config: SessionConfig, catalog: Catalog | None = None):
        self.config, self.catalog = config.checked(), (catalog or builtin()).validated()
        self.attempted = self.emitted = self.measured = self.screened_out = self.imported = 0
        self.seen: set[str] = set()
        self.history: ExcludedHistory | None = None
        self.referenced = False
        self.parents: list[tuple[Proposal, float]] = []
        self.pending: list[Proposal] = []
        self._cover: list | None = None

    # starting from what is known
    @staticmethod
    def from_measured(config: SessionConfig, seeds: Iterable[dict], excluded: Iterable[str] | ExcludedHistory = (), catalog: Catalog | None = None) -> Session:
        """``seeds``: record_id, expression, outcome. They become parents; ``excluded`` fingerprints are never proposed."""
        s = Session(config, catalog)
        if isinstance(excluded, ExcludedHistory):
            s.history, s.referenced = excluded.checked(), True
        elif (entries := frozenset(excluded)):
            s.history = ExcludedHistory(entries).checked()
        ids: set[str] = set()
        for seed in seeds:
            _require(bool(str(seed["record_id"]).strip()) and seed["record_id"] not in ids, "seed ids must be distinct and non-blank")
            ids.add(seed["record_id"])
            node = parse(seed["expression"], s.catalog)
            a = analyze(node)
            _require(a.rejection_reason is None and transform.valid(node, config.limits, s.catalog), f"seed `{seed['record_id']}` is trivial or beyond the limits")
            _require(math.isfinite(seed["outcome"]), "non-finite outcome")
            _require(a.semantic_fingerprint not in s.seen, "seeds repeat one another")
            s.seen.add(a.semantic_fingerprint)
            s.imported += 1
            s.emitted += 1
            p = Proposal(s.emitted, canonical(node), a.semantic_fingerprint, Provenance("initial", "measured_seed").to_dict())
            s.parents.append((p, float(seed["outcome"])))
        _require(s.imported > 0, "at least one seed is required")
        s._retain()
        return s

    # proposing
    def ask(self) -> list[Proposal]:
        """The pending batch; a new one only once the last has been told."""
        c = self.config
        if self.pending:
            return list(self.pending)
        target = min(c.batch_size, c.max_evaluations - (self.emitted - self.imported))
        nodes = [parse(p.expression, self.catalog) for p, _ in self.parents]
        while len(self.pending) < target and self.attempted < c.max_attempts:
            index = self.attempted
            self.attempted += 1
            node, provenance = self._draw(index, nodes)
            if not transform.valid(node, c.limits, self.catalog):
                continue
            a = analyze(node)
            if a.rejection_reason is not None or a.semantic_fingerprint in self.seen or (self.history and a.semantic_fingerprint in self.history.entries):
                continue
            self.seen.add(a.semantic_fingerprint)
            self.emitted += 1
            self.pending.append(Proposal(self.emitted, canonical(node), a.semantic_fingerprint, provenance.to_dict()))
        return list(self.pending)

    def _draw(self, index: int, nodes: list) -> tuple:
        c = self.config
        if not nodes or index % c.exploration_every == 0:
            if c.exploration_policy == "fixed_cover":
                self._cover = self._cover if self._cover is not None else transform.cover("fixed", c.seed, c.limits, self.catalog)
                if index < len(self._cover):
                    return self._cover[index]
            return transform.sample(c.seed, index, c.limits, self.catalog)
        rng = rng_for("session", c.seed, index)
        left = rng.randrange(len(nodes))
        if len(nodes) > 1 and rng.random() < 0.5:
            right = (left + rng.randrange(1, len(nodes))) % len(nodes)
            return transform.crossover(nodes[left], nodes[right], c.seed, index, c.limits, self.catalog)
        return transform.mutate(nodes[left], c.seed, index, c.limits, self.catalog, applicable=c.mutation_policy == "applicable")

    def score_requests(self) -> list[Proposal]:
        """What the next ``tell`` must score: parents and pending, or only pending for latest-batch policies."""
        return list(self.pending) if self.config.latest_batch else [*(p for p, _ in self.parents), *self.pending]

    # learning
    def tell(self, evaluator_context: str, pool_context: str, outcomes: dict[str, float] | Iterable[tuple[str, float]]) -> None:
        """A score for each of ``score_requests``, by semantic fingerprint. On an error nothing changes."""
        self._apply(evaluator_context, pool_context, outcomes, screened=False)

    def tell_screened(self, evaluator_context: str, pool_context: str, outcomes: dict[str, float] | Iterable[tuple[str, float]]) -> None:
        """Scores of all parents and at least one pending proposal; the other pending ones are screened out for good."""
        _require(not self.config.latest_batch and self.config.parent_selection in ("score", "score_diverse_v1"), "screened feedback needs a snapshot score policy")
        self._apply(evaluator_context, pool_context, outcomes, screened=True)

    def _apply(self, evaluator_context: str, pool_context: str, outcomes, screened: bool) -> None:
        _require(evaluator_context == self.config.evaluator_context, "evaluator context differs")
        _require(bool(pool_context.strip()) and len(pool_context.encode()) <= 4096, "pool context must be non-blank and at most 4096 bytes")
        _require(bool(self.pending), "no pending batch")
        pairs = list(outcomes.items() if isinstance(outcomes, dict) else outcomes)
        scores = dict(pairs)
        _require(len(scores) == len(pairs), "duplicate outcome")
        _require(all(math.isfinite(v) for v in scores.values()), "non-finite outcome")
        requests = self.score_requests()
        wanted = {p.semantic_fingerprint for p in requests}
        _require(set(scores) <= wanted, "unexpected outcome")
        incumbents = wanted - {p.semantic_fingerprint for p in self.pending}
        if screened:
            _require(incumbents <= set(scores) and len(scores) > len(incumbents), "a screened snapshot needs all parents and a pending proposal")
        else:
            _require(set(scores) == wanted, "incomplete snapshot")
        told = [p for p in self.pending if p.semantic_fingerprint in scores]
        self.measured += len(told)
        self.screened_out += len(self.pending) - len(told)
        self.parents = [(p, float(scores[p.semantic_fingerprint])) for p in requests if p.semantic_fingerprint in scores]
        self.pending = []
        self._retain()

    def _retain(self) -> None:
        c = self.config
        by_score = lambda x: (-x[1], x[0].ordinal)
        if c.parent_selection in ("score", "latest_batch_score_v1"):
            self.parents = sorted(self.parents, key=by_score)[: c.parent_capacity]
        elif c.parent_selection == "score_diverse_v1":
            self.parents = self._diverse(sorted(self.parents, key=by_score))
        else:  # uniform: neither scores nor contexts matter
            pool = sorted(self.parents, key=lambda x: x[0].ordinal)
            rng_for("retain", c.parent_selection, c.seed, self.emitted).shuffle(pool)
            self.parents = sorted(pool[: c.parent_capacity], key=lambda x: x[0].ordinal)

    def _diverse(self, ordered: list) -> list:
        """The better half of the places to the best, then those not below 0 and at least 0.15 from all chosen, then the rest."""
        capacity = self.config.parent_capacity
        kinds = {p.semantic_fingerprint: describe(parse(p.expression, self.catalog), (), self.catalog) for p, _ in ordered}
        chosen = ordered[: -(-capacity // 2)]
        for p, v in ordered[len(chosen) :]:
            if len(chosen) < capacity and v >= 0 and all(distance(kinds[p.semantic_fingerprint], kinds[q.semantic_fingerprint]) >= 0.15 for q, _ in chosen):
                chosen.append((p, v))
        taken = {p.ordinal for p, _ in chosen}
        chosen += [x for x in ordered if x[0].ordinal not in taken][: capacity - len(chosen)]
        return sorted(chosen, key=lambda x: (-x[1], x[0].ordinal))

    # checkpoints
    def checkpoint(self) -> str:
        """Everything as JSON; a shared history is only referred to, by checksum."""
        out = {
            "schema": 3 if self.referenced else 2 if self.imported or self.screened_out or self.history else 1, "config": dataclasses.asdict(self.config), "catalog": self.catalog.checksum,
            "attempted": self.attempted, "emitted": self.emitted, "measured": self.measured, "screened_out": self.screened_out, "imported": self.imported, "seen": sorted(self.seen),
            "parents": [[dataclasses.asdict(p), v] for p, v in self.parents], "pending": [dataclasses.asdict(p) for p in self.pending],
        }
        if self.history:
            out["history_checksum" if self.referenced else "excluded"] = self.history.checksum if self.referenced else sorted(self.history.entries)
        return json.dumps(out, sort_keys=True)

    @staticmethod
    def restore(text: str, config: SessionConfig, catalog: Catalog | None = None, history: ExcludedHistory | None = None) -> Session:
        """The session of a checkpoint, all of it validated again."""
        _require(len(text.encode()) <= CHECKPOINT_BYTES, "the checkpoint is too large")
        try:
            d = json.loads(text)
        except json.JSONDecodeError as e:
            raise SessionError(f"not a checkpoint: {e}") from e
        _require(isinstance(d, dict) and d.get("schema") in (1, 2, 3), "unsupported checkpoint schema")
        try:
            return Session._rebuilt(d, config, catalog, history)
        except (KeyError, TypeError, AttributeError) as e:
            raise SessionError(f"the checkpoint is corrupt: {e}") from e

    @staticmethod
    def _rebuilt(d: dict, config: SessionConfig, catalog: Catalog | None, history: ExcludedHistory | None) -> Session:
        s = Session(config, catalog)
        _require(d["config"] == json.loads(json.dumps(dataclasses.asdict(config))) and d["catalog"] == s.catalog.checksum, "config or catalog differs from the checkpoint's")
        for name in ("attempted", "emitted", "measured", "screened_out", "imported"):
            _require(isinstance(d[name], int) and d[name] >= 0, f"invalid counter {name}")
            setattr(s, name, d[name])
        _require(isinstance(d["seen"], list) and all(isinstance(x, str) and _SHA.match(x) for x in d["seen"]) and len(set(d["seen"])) == len(d["seen"]), "the identities seen are corrupt")
        s.seen = set(d["seen"])
        s.parents = [(Proposal(**p), v) for p, v in d["parents"]]
        s.pending = [Proposal(**p) for p in d["pending"]]
        if d["schema"] == 3:
            _require(history is not None and history.checked().checksum == d["history_checksum"], "the checkpoint refers to another history")
            s.history, s.referenced = history, True
        elif "excluded" in d:
            s.history = ExcludedHistory(frozenset(d["excluded"])).checked()
        _require(s.emitted == s.imported + s.measured + s.screened_out + len(s.pending) and s.emitted == len(s.seen) and s.emitted - s.imported <= config.max_evaluations, "counters don't add up")
        _require(s.emitted - s.imported <= s.attempted <= config.max_attempts, "more attempts than allowed, or fewer than proposals")
        ordinals = [p.ordinal for p, _ in s.parents] + [p.ordinal for p in s.pending]
        _require(all(isinstance(o, int) and 1 <= o <= s.emitted for o in ordinals) and len(set(ordinals)) == len(ordinals), "ordinals are out of range or repeat")
        _require([p.ordinal for p in s.pending] == list(range(s.emitted - len(s.pending) + 1, s.emitted + 1)), "the pending batch isn't the last one proposed")
        _require(len(s.parents) <= config.parent_capacity and len(s.pending) <= config.batch_size, "too many parents or proposals")
        known: set[str] = set()
        for p in [*(p for p, _ in s.parents), *s.pending]:
            node = parse(p.expression, s.catalog)
            _require(canonical(node) == p.expression and analyze(node).semantic_fingerprint == p.semantic_fingerprint and p.semantic_fingerprint in s.seen and p.semantic_fingerprint not in known, f"proposal {p.ordinal} is corrupt")
            known.add(p.semantic_fingerprint)
        _require(all(math.isfinite(v) for _, v in s.parents), "non-finite outcome")
        return s

    def counters(self) -> dict[str, int]:
        return {k: getattr(self, k) for k in ("attempted", "emitted", "measured", "screened_out", "imported")}


def serve(lines: Iterable[str], write) -> None:
    """One JSON request a line (init, init_measured, restore, ask, tell, tell_screened, checkpoint), one answer each."""
    session: Session | None = None
    for line in lines:
        if not line.strip():
            continue
        try:
            r = json.loads(line)
            op = r.get("op")
            catalog = Catalog.from_json(json.dumps(r["catalog"])) if r.get("catalog") else None
            if op == "init":
                session, answer = Session(SessionConfig.from_dict(r["config"]), catalog), {}
            elif op == "init_measured":
                config = SessionConfig.from_dict(r["config"])
                _require(r.get("evaluator_context", config.evaluator_context) == config.evaluator_context, "evaluator context differs")
                session, answer = Session.from_measured(config, r["seeds"], r.get("excluded", ()), catalog), {}
            elif op == "restore":
                session, answer = Session.restore(r["checkpoint"], SessionConfig.from_dict(r["config"]), catalog), {}
            else:
                _require(session is not None, "no session")
                if op == "ask":
                    answer = {"proposals": [dataclasses.asdict(p) for p in session.ask()], "score_requests": [dataclasses.asdict(p) for p in session.score_requests()]}
                elif op in ("tell", "tell_screened"):
                    pairs = [(o["semantic_fingerprint"], o["outcome"]) for o in r["outcomes"]]
                    getattr(session, op)(r["evaluator_context"], r["pool_context"], pairs)
                    answer = {}
                elif op == "checkpoint":
                    answer = {"checkpoint": session.checkpoint()}
                else:
                    raise SessionError(f"unknown op `{op}`")
            write(json.dumps({"ok": True, **answer, "counters": session.counters()}) + "\n")
        except (ValueError, KeyError, TypeError) as e:
            write(json.dumps({"ok": False, "error": str(e)}) + "\n")
