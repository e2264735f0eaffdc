"""Bounded evolutionary search over formulas, reproducible from its specification."""

from __future__ import annotations

import bisect
import dataclasses
import hashlib
import json
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from panelforge.expr.analysis import analyze
from panelforge.expr.ast import Node
from panelforge.expr.canonical import canonical, fingerprint
from panelforge.expr.catalog import Catalog, builtin
from panelforge.expr.descriptor import Descriptor, describe
from panelforge.expr.parser import parse
from panelforge.plans.workers import ship
from panelforge.search import transform
from panelforge.search.artifacts import SCHEMA, ArtifactError, write_json
from panelforge.search.feedback import FeedbackConfig, FeedbackDataset, PolicyConfig, features
from panelforge.search.scoring import Mask, ScoreWeights, components, mask_distance, score
from panelforge.search.transform import COVERS, Limits, Provenance

INITIAL, BATCH = 64, 128


@dataclass(frozen=True)
class SearchSpec:
    seed: int = 0
    max_candidates: int = 1000
    shortlist: int = 100
    population: int = 512
    parents: int = 128
    elites: int = 4096
    semantic_ids: int = 100_000
    batch: int = BATCH
    limits: Limits = field(default_factory=Limits)
    weights: ScoreWeights = field(default_factory=ScoreWeights)
    cover: str = "fixed"
    seed_from_archive: bool = False  # the archive is the first population; its formulas don't come out
    freeze_parents: bool = False  # parents stay those of the archive
    feedback_elites: int = 0  # places among the parents for the best measured or guided
    seconds: float | None = None
    pause_after: int | None = None  # generations, for checkpoints

    def checked(self) -> SearchSpec:
        self.limits.checked()
        self.weights.normalized()
        bounds = {"max_candidates": 10_000_000, "shortlist": 100_000, "population": 1_000_000, "parents": 1_000_000, "elites": 1_000_000, "semantic_ids": 100_000_000, "batch": 1_000_000}
        for name, most in bounds.items():
            if not 1 <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be between 1 and {most}")
        if self.cover not in ("fixed", "seeded_diverse", "motif_diverse"):
            raise ValueError(f"unknown cover policy `{self.cover}`")
        if self.freeze_parents and not self.seed_from_archive:
            raise ValueError("frozen parents need seeding from the archive")
        if not 0 <= self.feedback_elites <= self.parents:
            raise ValueError("feedback_elites must be between 0 and the number of parents")
        return self

    @property
    def identity(self) -> dict:
        """What decides the result; deadlines and pauses don't."""
        d = dataclasses.asdict(self)
        return {k: v for k, v in d.items() if k not in ("seconds", "pause_after")}


@dataclass
class Made:
    """What one slot of a batch gave; what is turned away has a reason and no description."""

    text: str
    identity: str | None
    reason: str | None
    provenance: Provenance
    fingerprint: str = ""
    descriptor: Descriptor | None = None
    root_family: str = ""
    nodes: int = 0
    depth: int = 0
    operator_count: int = 0


@dataclass
class Draft:
    made: Made
    ordinal: int
    pool: dict
    parts: dict[str, float] | None = None
    score: float = 0.0

    text = property(lambda self: self.made.text)
    semantic = property(lambda self: self.made.identity)
    provenance = property(lambda self: self.made.provenance)
    descriptor = property(lambda self: self.made.descriptor)
    nodes = property(lambda self: self.made.nodes)

    @property
    def key(self) -> tuple:
        return (-self.score, self.nodes, self.semantic)

    @cached_property
    def bucket(self) -> tuple:
        return (transform.KINDS.index(self.provenance.kind), self.made.root_family, node_bucket(self.nodes))

    @cached_property
    def worth(self) -> tuple:
        """Order in which elites are kept: worth most, then smaller, then by fingerprint."""
        return (-retention_value(self.descriptor), self.nodes, self.semantic)


# What each part of a descriptor adds to the worth of keeping a formula.
RETENTION = {"operator_shingles": 8, "operator_histogram": 5, "field_families": 7, "fields": 3, "window_buckets": 4, "groups": 5, "lineage_parents": 2}
RETENTION_FLAGS = {"nonlinear": 3, "conditional": 5}


def retention_value(d: Descriptor) -> int:
    return sum(w * len(getattr(d, n)) for n, w in RETENTION.items()) + sum(w for n, w in RETENTION_FLAGS.items() if getattr(d, n))


class Elites:
    """The drafts worth keeping, by bucket and in order of worth; at most ``limit`` after ``bound``."""

    def __init__(self, limit: int, drafts: Iterable[Draft] = ()):
        self.limit, self.queues, self.size = limit, {}, 0
        for d in drafts:
            self.add(d)

    def __iter__(self) -> Iterator[Draft]:
        return (d for k in sorted(self.queues) for d in self.queues[k])

    def __len__(self) -> int:
        return self.size

    def add(self, d: Draft) -> None:
        bisect.insort(self.queues.setdefault(d.bucket, []), d, key=lambda x: x.worth)
        self.size += 1

    def bound(self) -> None:
        """Keeps those that come first when the buckets take turns in the order of their keys."""
        if self.size <= self.limit:
            return
        sizes = sorted(map(len, self.queues.values()))
        rounds, left = 0, self.limit
        for i, n in enumerate(sizes):  # whole rounds that all queues of this size or more can have
            more = min(n - rounds, left // (len(sizes) - i))
            rounds, left = rounds + more, left - more * (len(sizes) - i)
            if rounds < n:
                break
        for k in sorted(self.queues):
            extra = left > 0 and len(self.queues[k]) > rounds
            left -= extra
            del self.queues[k][rounds + extra :]
        self.queues = {k: q for k, q in self.queues.items() if q}
        self.size = sum(map(len, self.queues.values()))


def node_bucket(n: int) -> int:
    return next((i for i, most in enumerate((5, 12, 24, 48, 96)) if n <= most), 5)


def in_turns(drafts: list[Draft], limit: int) -> list[Draft]:
    """Best first of each (kind, root family, size) in turn; queues by their best."""
    queues: dict[tuple, deque] = {}
    for d in drafts:  # already in order
        queues.setdefault(d.bucket, deque()).append(d)
    out: list[Draft] = []
    order = list(queues.values())
    while order and len(out) < limit:
        for q in order:
            if len(out) == limit:
                break
            out.append(q.popleft())
        order = [q for q in order if q]
    return out


@dataclass(frozen=True)
class ActionPolicy:
    """How often to mutate or cross, and by which classes, as whole weights."""

    mutation: int = 1
    crossover: int = 2
    classes: tuple[tuple[str, int], ...] = tuple((c, 1) for c in transform.MUTATIONS)


def action_policy(archive: list[dict], dataset: FeedbackDataset, config: PolicyConfig | None = None) -> ActionPolicy:
    """Weights moved by the measured outcomes of the archive's formulas, by how they were made.

    An action with enough measured formulas is multiplied by 1 + strength x (20 x (its mean outcome less the overall
    mean), within -1 and 1), within the policy's bounds; outcomes are weighted by confidence.
    """
    config = (config or PolicyConfig()).checked()
    known = {r.semantic_fingerprint: (r.outcome, r.confidence) for r in dataset.checked().records if r.semantic_fingerprint}
    if not known:
        raise ValueError("the dataset has no fingerprints")
    mean = lambda xs: sum(o * c for o, c in xs) / sum(c for _, c in xs)
    overall = mean(list(known.values()))

    def weight(base: int, made: Callable[[dict], bool]) -> int:
        measured = [known[r["semantic_fingerprint"]] for r in archive if r["semantic_fingerprint"] in known and made(r["provenance"])]
        share = min(max(20 * (mean(measured) - overall), -1.0), 1.0) if len(measured) >= config.minimum_support else 0.0
        multiplier = min(max(1 + config.strength * share, config.exploration_floor), config.maximum_multiplier)
        return int(min(max(base * config.weight_scale * multiplier + 0.5, 1), 65535))

    classes = tuple((c, weight(1, lambda p, o=o: p["kind"] == "mutation" and p["operation"] == o)) for c, o in transform.MUTATIONS.items())
    return ActionPolicy(weight(1, lambda p: p["kind"] == "mutation"), weight(2, lambda p: p["kind"] == "crossover"), classes)


def neighbour_guidance(dataset: FeedbackDataset, config: FeedbackConfig) -> Callable[[Draft], float | None]:
    """The conservative outcome of a draft by its nearest measured records, or its own; None without enough of them.

    For the few hundred drafts of a generation; ``feedback.guided`` does the same for tables.
    """
    dataset.checked(), config.checked()
    keys = sorted(dataset.feature_scales)
    scales = np.array(dataset.scales)
    vec = np.array([[r.features[k] for k in keys] for r in dataset.records])
    outcome, confidence = (np.array([getattr(r, n) for r in dataset.records]) for n in ("outcome", "confidence"))
    order = np.argsort(np.argsort([r.record_id for r in dataset.records]))
    own = {r.semantic_fingerprint: r.outcome for r in dataset.records if r.semantic_fingerprint}
    known: dict[str, float | None] = {}

    def guide(d: Draft) -> float | None:
        if d.semantic in own:
            return own[d.semantic]
        if d.semantic not in known:
            f = features(d.descriptor, d.made.root_family, d.made.nodes, d.made.depth)
            far = np.minimum(np.abs(vec - np.array([f[k] for k in keys])) / scales, 1.0).mean(1)
            near = np.flatnonzero(far <= config.maximum_distance)
            near = near[np.lexsort((order[near], far[near]))][: config.neighbors]
            value = None
            if len(near) >= config.minimum_neighbors:
                w = np.maximum(1 - far[near], 1e-9) ** 2 * confidence[near]
                m = float((w * outcome[near]).sum() / w.sum())
                spread = float(np.sqrt(max((w * outcome[near] ** 2).sum() / w.sum() - m * m, 0.0)))
                value = min(1.0, max(-1.0, m - spread / np.sqrt(len(near))))
            known[d.semantic] = value
        return known[d.semantic]

    return guide


def compatible(catalog: Catalog) -> Catalog:
    """A search catalog has only built-in operators of the same grammar; windows may be narrower, variadics fixed."""
    for o in catalog.operators:
        b = builtin().operator(o.name)
        if b is None:
            raise ValueError(f"operator `{o.name}` is not built in")
        if o.output != b.output or o.arity[0] < b.arity[0] or o.arity[1] > b.arity[1] or [k.name for k in o.keywords] != [k.name for k in b.keywords]:
            raise ValueError(f"operator `{o.name}` has another grammar than the built-in one")
    return catalog.validated()


class _Seen:
    """Semantic identities, the oldest forgotten beyond the capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.ids = capacity, OrderedDict()

    def add(self, identity: str) -> bool:
        if identity in self.ids:
            return False
        self.ids[identity] = None
        if len(self.ids) > self.capacity:
            self.ids.popitem(last=False)
        return True


def prepare(node: Node, provenance: Provenance, limits: Limits, catalog: Catalog) -> Made:
    """The formula of its text, described, or why it is turned away."""
    node = transform.read_back(node, catalog)
    if not limits.accepts(node, catalog):
        return Made(canonical(node), None, "limits", provenance)
    a = analyze(node)
    if a.rejection_reason is not None:
        return Made(canonical(node), a.semantic_fingerprint, a.rejection_reason, provenance)
    d = describe(node, provenance.parent_fingerprints, catalog)
    _keep_tree(node, catalog)
    return Made(canonical(node), a.semantic_fingerprint, None, provenance, fingerprint(node), d, node.operator or "field", node.node_count, node.depth, node.operator_count)


def _packed(m: Made) -> str:
    return json.dumps([m.text, m.identity, m.reason, m.provenance.to_dict(), m.fingerprint, m.descriptor and dataclasses.asdict(m.descriptor), m.root_family, m.nodes, m.depth, m.operator_count])


def _unpacked(text: str) -> Made:
    t, identity, reason, p, own, d, *rest = json.loads(text)
    lists = lambda x: {k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}
    return Made(t, identity, reason, Provenance(**lists(p)), own, d and Descriptor(**lists(d)), *rest)


_TREES: dict[tuple[str, str], Node] = {}


def _keep_tree(node: Node, catalog: Catalog) -> Node:
    if len(_TREES) >= 16_384:
        _TREES.clear()
    _TREES[catalog.checksum, canonical(node)] = node
    return node


def tree_of(text: str, catalog: Catalog) -> Node:
    """The tree of a formula's canonical text; parents stay for many generations, so each process keeps some trees."""
    known = _TREES.get((catalog.checksum, text))
    return known if known is not None else _keep_tree(parse(text, catalog), catalog)


class Search:
    """One run. Offspring are a function of (seed, generation, slot, parents), so they may be made anywhere.

    With a Spark session the offspring of a generation are made, analysed and described by tasks, one job a generation;
    without one on the driver. The result is the same, merged in the order of slots. ``clock`` gives seconds, for deadlines.
    """

    def __init__(self, spec: SearchSpec, catalog: Catalog | None = None, archive: list[str] | None = None, spark: SparkSession | None = None, guidance: Callable[[Draft], float | None] | None = None, policy: ActionPolicy | None = None, clock: Callable[[], float] = time.monotonic):
        self.spec, self.catalog = spec.checked(), compatible(catalog or builtin())
        if spec.feedback_elites and guidance is None:
            raise ValueError("feedback elites need guidance")
        if policy is not None and guidance is None:
            raise ValueError("an action policy needs guidance")
        if (spec.seed_from_archive or policy is not None) and not archive:
            raise ValueError("seeding and action policies need an archive")
        self.policy = policy or ActionPolicy()
        self.given_policy = policy is not None
        self.spark, self.guidance, self.clock = spark, guidance, clock
        self.weights = spec.weights.normalized()
        self.archive: list[Mask] = []
        self.seen = _Seen(spec.semantic_ids)
        ids, texts = [], []
        for text in archive or []:
            node = parse(text, self.catalog)
            a = analyze(node)
            if a.rejection_reason is None and self.seen.add(a.semantic_fingerprint):
                ids.append(a.semantic_fingerprint)
                self.archive.append(Mask(describe(node, (), self.catalog)))
                texts.append(canonical(node))
        self.archive_checksum = hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()
        self.archive_texts = texts
        if spec.seed_from_archive and not texts:
            raise ValueError("the archive has no usable formula")
        self.run_id = hashlib.sha256(json.dumps([spec.identity, self.catalog.checksum, self.archive_checksum, dataclasses.asdict(self.policy) if policy else None, guidance is not None], sort_keys=True).encode()).hexdigest()
        self.population: list[Draft] = []
        self.elites = Elites(spec.elites)
        self.counts = dict.fromkeys(("attempted", "accepted", "duplicates", "trivial", "invalid", "generations"), 0)

    # making candidates
    def _admit(self, batch: Iterable[Made]) -> None:
        """Takes a batch in, in its order; what is new joins the population and the bounded archive of elites."""
        for m in batch:
            self.counts["attempted"] += 1
            if m.reason == "limits" or m.identity is None:
                self.counts["invalid"] += 1
            elif m.reason is not None:
                self.counts["trivial"] += 1
            elif not self.seen.add(m.identity):
                self.counts["duplicates"] += 1
            else:
                self.counts["accepted"] += 1
                d = self._draft(m, self.counts["attempted"])
                self.population.append(d)
                self.elites.add(d)
        self.elites.bound()

    def _draft(self, m: Made, ordinal: int) -> Draft:
        return Draft(m, ordinal, {"mask": Mask(m.descriptor), "root_family": m.root_family, "operator_count": m.operator_count, "nodes": m.nodes, "parents": m.provenance.parent_fingerprints, "kind": m.provenance.kind})

    def _offspring(self, generation: int, slots: range, parents: list[str]) -> Iterator[Made]:
        seed, limits, catalog, policy = self.spec.seed, self.spec.limits, self.catalog, self.policy if self.given_policy else None
        if self.spark is None:
            nodes = [tree_of(p, catalog) for p in parents]
            yield from (_make(seed, generation, slot, nodes, limits, catalog, policy) for slot in slots)
            return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes = [tree_of(p, catalog) for p in parents]
            for batch in batches:
                made = [_packed(_make(seed, generation, s, nodes, limits, catalog, policy)) for s in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["slot", "made"])

        ship(self.spark)
        rows = self.spark.range(slots.start, slots.stop).mapInArrow(run, "slot long, made string").collect()  # one batch; its size is a parameter
        yield from (_unpacked(r["made"]) for r in sorted(rows, key=lambda r: r["slot"]))

    # scoring and keeping
    def _score(self, drafts: list[Draft]) -> None:
        for d, parts in zip(drafts, components([d.pool for d in drafts], self.archive)):
            d.parts, d.score = parts, score(parts, self.weights)

    def _ordered(self, drafts: list[Draft]) -> list[Draft]:
        if self.guidance is None:
            return sorted(drafts, key=lambda d: d.key)
        known = {id(d): self.guidance(d) for d in drafts}
        return sorted(drafts, key=lambda d: (known[id(d)] is None, -(known[id(d)] or 0.0), d.key))

    def run(self, checkpoint: str | None = None, resume: dict | None = None) -> tuple[list[dict], dict]:
        """(shortlist records, manifest). With ``checkpoint`` the state is written after each generation.

        A deadline ends the generations a quarter of the time, at most a quarter of a second, early; then the shortlist
        comes from the first 2 x shortlist of the population, else from all elites.
        """
        spec, began = self.spec, self.clock()
        end = None if spec.seconds is None else began + spec.seconds
        stop = None if end is None else end - min(spec.seconds / 4, 0.25)
        if resume is not None:
            self._restore(resume)
        else:
            self._admit(prepare(node, provenance, spec.limits, self.catalog) for node, provenance in self._initial())
            self._turn()
        reason = "max_candidates"
        first = self.counts["generations"]
        while self.counts["attempted"] < spec.max_candidates:
            if stop is not None and self.clock() >= stop:
                reason = "duration_deadline"
                break
            if spec.pause_after is not None and self.counts["generations"] - first >= spec.pause_after:
                reason = "checkpoint_pause"
                break
            if checkpoint:
                write_json(checkpoint, self.state())
            n = min(spec.batch, spec.max_candidates - self.counts["attempted"])
            generation = self.counts["generations"] + 1
            self._admit(self._offspring(generation, range(n), self._parents()))
            self.counts["generations"] = generation
            if stop is not None and self.clock() >= stop:
                self.population = self.population[: spec.population]
                reason = "duration_deadline"
                break
            self._turn()
        if checkpoint:
            write_json(checkpoint, self.state())
        final = self.population[: 2 * spec.shortlist] if reason == "duration_deadline" else list(self.elites)
        self._score(final)
        late = None if end is None else lambda: self.clock() >= end - 0.025
        chosen = shortlist(self._ordered(final), spec.shortlist, self.guidance, late)
        manifest = {
            "schema": 8, "run_id": self.run_id, "spec": spec.identity, "catalog_checksum": self.catalog.checksum, "archive_checksum": self.archive_checksum, "termination": reason, "counts": self.counts, "shortlist": len(chosen),
            "seconds": round(self.clock() - began, 3),
        }
        return [self.record(d) for d in chosen], manifest

    def _turn(self) -> None:
        """The best of the population, in turns, stay, in that order."""
        self._score(self.population)
        self.population = in_turns(self._ordered(self.population), self.spec.population)

    def _parents(self) -> list[str]:
        """Feedback elites first, then the population in turns; the archive's formulas where they seed or stay."""
        spec = self.spec
        if spec.freeze_parents:
            return self.archive_texts[: spec.parents]
        measured = [d for d in self._ordered(self.population) if self.guidance(d) is not None][: spec.feedback_elites] if spec.feedback_elites else []
        texts = [d.text for d in (*measured, *self.population[: spec.parents])]
        if spec.seed_from_archive and len(texts) < spec.parents:
            texts += self.archive_texts
        return list(dict.fromkeys(texts))[: spec.parents] or [f.name for f in self.catalog.fields]

    def _initial(self) -> Iterator[tuple[Node, Provenance]]:
        if self.spec.seed_from_archive:
            return
        made = transform.cover(self.spec.cover, self.spec.seed, self.spec.limits, self.catalog)
        for i in range(min(INITIAL, self.spec.max_candidates)):
            yield made[i] if i < len(made) else transform.sample(self.spec.seed, i, self.spec.limits, self.catalog)

    def record(self, d: Draft) -> dict:
        return {
            "schema": SCHEMA, "run_id": self.run_id, "expression": d.text, "fingerprint": d.made.fingerprint, "semantic_fingerprint": d.semantic, "structural_score": d.score, "score_schema": 1, "score_components": d.parts,
            "normalized_weights": self.weights, "structural_descriptor": d.descriptor.to_dict(), "root_family": d.made.root_family, "nodes": d.nodes, "depth": d.made.depth, "provenance": d.provenance.to_dict(),
        }

    # checkpoints
    def state(self) -> dict:
        pack = lambda ds: [{"text": d.text, "provenance": d.provenance.to_dict(), "ordinal": d.ordinal, "parts": d.parts, "score": d.score} for d in ds]
        return {"schema": 2, "run_id": self.run_id, "counts": self.counts, "seen": list(self.seen.ids), "population": pack(self.population), "elites": pack(self.elites)}

    def _restore(self, state: dict) -> None:
        if state.get("schema") != 2 or state.get("run_id") != self.run_id:
            raise ArtifactError("the checkpoint is of another run")
        self.counts = dict(state["counts"])
        self.seen.ids = OrderedDict.fromkeys(state["seen"])

        def unpack(x: dict) -> Draft:
            p = x["provenance"]
            provenance = Provenance(**{**p, "parent_fingerprints": tuple(p["parent_fingerprints"])})
            d = self._draft(prepare(parse(x["text"], self.catalog), provenance, self.spec.limits, self.catalog), x["ordinal"])
            d.parts, d.score = x["parts"], x["score"]
            return d

        self.elites = Elites(self.spec.elites, map(unpack, state["elites"]))
        known = {d.semantic: d for d in self.elites}
        self.population = [known.get(d.semantic, d) for d in map(unpack, state["population"])]


def _make(seed: int, generation: int, slot: int, parents: list[Node], limits: Limits, catalog: Catalog, policy: ActionPolicy | None = None) -> Made:
    index = (generation << 32) | slot
    rng = transform.rng_for("offspring", seed, generation, slot)
    left = parents[rng.randrange(len(parents))]
    cls = None
    mutation = slot % 3 == 0
    if policy is not None:
        mutation = rng.random() * (policy.mutation + policy.crossover) < policy.mutation
        cls = rng.choices([c for c, _ in policy.classes], [w for _, w in policy.classes])[0]
    if mutation or len(parents) < 2:
        node, provenance = transform.mutate(left, seed, index, limits, catalog, cls)
    else:
        node, provenance = transform.crossover(left, parents[rng.randrange(len(parents))], seed, index, limits, catalog)
    return prepare(node, provenance, limits, catalog)


def shortlist(ordered: list[Draft], limit: int, guidance: Callable[[Draft], float | None] | None = None, late: Callable[[], bool] | None = None) -> list[Draft]:
    """Up to half from the starting cover, then in turns by (kind, size) the one of the next 32 that adds most.

    It adds its score + 0.35 x the distance to the nearest of up to 32 chosen ones; with a measured outcome, that outcome
    + 0.05 x the distance, and such come first. Once ``late``, the rest is taken in order. More of the starting cover
    than its half never comes in.
    """
    scaffold = [d for d in ordered if d.provenance.operation in COVERS]
    chosen = scaffold[: min(-(-limit // 2), len(scaffold))]
    rest = [d for d in ordered if d.provenance.operation not in COVERS]
    groups: dict[tuple, list[Draft]] = {}
    for d in rest:
        groups.setdefault((transform.KINDS.index(d.provenance.kind), node_bucket(d.nodes)), []).append(d)
    keys = sorted(groups)
    while len(chosen) < limit and any(groups.values()):
        if late is not None and late():
            taken = {id(d) for d in chosen}
            chosen += [d for d in rest if id(d) not in taken][: limit - len(chosen)]
            break
        for k in keys:
            if not groups[k] or len(chosen) == limit:
                continue
            against = chosen[:: max(1, len(chosen) // 32)][:32]
            best, at = None, 0
            for i, d in enumerate(groups[k][:32]):
                novelty = min((mask_distance(d.pool["mask"], c.pool["mask"]) for c in against), default=1.0)
                measured = guidance(d) if guidance else None
                value = (measured is not None, d.score + 0.35 * novelty if measured is None else measured + 0.05 * novelty)
                if best is None or value > best:
                    best, at = value, i
            chosen.append(groups[k].pop(at))
    return chosen
