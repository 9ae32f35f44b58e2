"""Embedding near-dedup over a robust-pruned flat graph.

Only vectors of one label and length can link, if their cosine reaches the bound. Equal
vectors are one node with a size. Nodes are dealt into overlapping cluster shards: a cell
with more than ``rows`` nodes is cut at medoids found on a sample of at most about
``SAMPLE`` of its nodes, in rounds, until every cell is small. Medoids that would link with
each other share a cell, so a group of near copies isn't torn apart, and a node also goes to
the next ``OVERLAP - 1`` cells if their border is nearer than half the linking distance (the
middle of a linked pair lies in one cell; its ends are no farther from that cell than this).
Such copies are not copied again in later rounds, so copies grow with the rounds, not as
their power. A cell
that has one medoid group (near copies of one another in great number) is cut into pieces by
hash instead, and each of its nodes is searched in every piece.

In each piece a flat graph is built: every node's neighbours are pruned robustly over all
nodes of the piece, nearest first (a candidate goes if a kept neighbour is ``ALPHA`` times
nearer to it than the node is), beside pruned far neighbours out of a sample, and edges are
made mutual. The adjacency lists of a node's shards are united. Queries are all nodes: a
greedy beam search starts from the piece's medoids; then the range expands: every node
found within the linking range and some slack is opened until none is left. The search is
audited: a query that did not find itself is searched from itself, and the queries of every
20th identifier are compared with brute force in the piece; while they miss a link, the
slack doubles and the range expands again (``audit`` gives the figures). Links are verified
with the cosine in double precision.

A pair that shares several shards counts in the first of them only, so links are summed
without being listed; components need one edge per node and piece.

Defined results: null, empty or zero vectors and vectors with null or non-finite components
link with nothing, nor do vectors without a label; a null identifier never names a component
unless no other does; repeated rows are vectors of their own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import settle, table
from runfold.llm.components import components

ROWS = 512
SAMPLE = 4096
CENTRES = 128
OVERLAP = 3
#: Neighbours kept near and far; entry points per so many nodes.
NEAR, FAR, PER_ENTRY = 16, 8, 64
ALPHA = 1.2
BEAM = 24
#: Queries searched at once, pairs compared at once.
QUERIES, PAIRS = 256, 1 << 15
SLACK = 0.02
AUDIT = 20
LEVELS = 12


# ------------------------------------------------------------------------ vectors
def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, and their norms. A power of two is taken out of
    each, so that no square overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def unit_rows(column: pa.Array) -> np.ndarray:
    x, norm = vectors(column)
    return x / norm[:, None]


# ------------------------------------------------------------------------- shards
def medoids(x: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` rows of ``x`` (norm 1) that lie central in clusters, and group numbers:
    medoids that link, or are joined by such, share one."""
    at = int(np.argmax(x @ x.mean(axis=0)))
    chosen, best = [at], x @ x[at]
    while len(chosen) < min(k, len(x)):
        at = int(np.argmin(best))
        if best[at] >= bound:
            break
        chosen.append(at)
        best = np.maximum(best, x @ x[at])
    for _ in range(5):
        near = np.argmax(x @ x[chosen].T, axis=1)
        mean = np.zeros((len(chosen), x.shape[1]))
        np.add.at(mean, near, x)
        chosen = sorted(set(np.argmax(x @ mean.T, axis=0).tolist()))
    m = x[chosen]
    group = np.arange(len(m))
    linked = m @ m.T >= bound
    while True:
        least = np.where(linked, group[None, :], len(m)).min(axis=1)
        if (least == group).all():
            break
        group = least
    return m, np.unique(group, return_inverse=True)[1]


def cells_of(x: np.ndarray, m: np.ndarray, group: np.ndarray, margin: float) -> np.ndarray:
    """Per row ``OVERLAP`` groups: that of its nearest medoid, and the next ones as far as
    their border is nearer than ``margin`` (else -1)."""
    near = x @ m.T
    i = np.arange(len(x))
    first = near.argmax(axis=1)
    out = np.full((len(x), OVERLAP), -1)
    out[:, 0] = group[first]
    rest = np.where(group[None, :] == group[first][:, None], -np.inf, near)
    for k in range(1, OVERLAP):
        other = rest.argmax(axis=1)
        apart = np.maximum(np.linalg.norm(m[first] - m[other], axis=1), 1e-12)
        close = np.isfinite(rest[i, other]) & ((near[i, first] - rest[i, other]) / apart <= margin)
        out[:, k] = np.where(close, group[other], -1)
        rest = np.where(group[None, :] == group[other][:, None], -np.inf, rest)
    return out


def _sampled(bound: float, rows: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("node")
        x, n = unit_rows(t.column("x").combine_chunks()), t.column("n")[0].as_py()
        m, group = medoids(x, max(2, min(CENTRES, -(-2 * OVERLAP * n // rows))), bound)
        return pa.table({"cell": t.column("cell").slice(0, 1), "n": t.column("n").slice(0, 1), "centres": pa.array([m.ravel()], pa.list_(pa.float64())),
                         "groups": pa.array([group], pa.list_(pa.int64()))})
    return run


def _dealt(margin: float):
    """Sorted by cell: its medoids (``centres``), then its nodes; out come nodes with
    their cells of the next round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = m = group = None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(3).is_valid().to_pylist()))
            begin = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or keys[i][1]), len(keys)]
            for lo, hi in zip(begin, begin[1:]):
                part = b.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                if keys[lo][1]:
                    cell, group = keys[lo][0], np.array(part.column(4)[0].as_py())
                    m = np.array(part.column(3)[0].as_py()).reshape(len(group), -1)
                    continue
                extra = part.column(5).to_numpy(zero_copy_only=False)
                for i, to in enumerate(cells_of(unit_rows(part.column(2)), m, group, margin).T):
                    here = (to >= 0) & ~(extra & (i > 0))  # a copy is not copied again
                    rows = part.take(pa.array(np.flatnonzero(here)))
                    yield pa.RecordBatch.from_arrays([pa.array([f"{cell}.{g}" for g in to[here].tolist()], pa.string()), rows.column(1), rows.column(2),
                                                      pa.array(extra[here] | (i > 0))], names=["cell", "node", "x", "extra"])
    return run


def shards(nodes: DataFrame, bound: float, rows: int = ROWS) -> DataFrame:
    """``cell``, ``piece``, ``pieces``, ``node``, ``x``: the overlapping shards."""
    margin = math.sqrt(2 - 2 * bound) / 2
    label = F.col("label").cast("string")
    now = nodes.select(F.concat(F.length(label).cast("string"), F.lit(":"), label, F.lit("/"), F.size("x").cast("string")).alias("cell"), "node", "x", F.lit(False).alias("extra"))
    kind = now.schema["x"].dataType.simpleString()
    done: DataFrame | None = None
    for level in range(LEVELS + 1):
        sizes = settle(now.groupBy("cell").agg(F.count("*").alias("n")), "cell-sizes")
        large = sizes.filter(F.col("n") > rows)
        if level == LEVELS or large.isEmpty():
            break
        sample = now.join(large, "cell").filter(F.pmod(F.xxhash64("node", F.lit(level)), "n") < SAMPLE)
        centres = settle(sample.groupBy("cell").applyInArrow(_sampled(bound, rows), "cell string, n long, centres array<double>, groups array<long>"), "centres")
        cut = centres.filter(F.array_max("groups") > 0)  # the others are dense: no use in cutting them
        slices = F.ceil(F.col("n") / rows)
        null = F.lit(None)
        lead = cut.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), null.cast("long").alias("node"),
                          null.cast(kind).alias("x"), "centres", "groups", F.lit(False).alias("extra"))
        body = now.join(cut.select("cell", slices.alias("of")), "cell").select(
            "cell", F.pmod(F.xxhash64("node", F.lit("slice")), "of").alias("slice"), "node", "x",
            null.cast("array<double>").alias("centres"), null.cast("array<long>").alias("groups"), "extra")
        in_order = lead.union(body).repartition("cell", "slice").sortWithinPartitions("cell", "slice", F.col("centres").isNull(), "node")
        small = now.join(cut, "cell", "left_anti")
        done = small if done is None else done.union(small)
        now = settle(in_order.select("cell", "node", "x", "centres", "groups", "extra").mapInArrow(
            _dealt(margin), f"cell string, node long, x {kind}, extra boolean"), "cells")
    all_ = now if done is None else done.union(now)
    sizes = all_.groupBy("cell").agg(F.ceil(F.count("*") / rows).alias("pieces"))
    return all_.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("node", F.lit("piece")), "pieces").alias("piece"), "pieces", "node", "x")


# -------------------------------------------------------------------------- graph
def robust_prune(dist: np.ndarray, alive: np.ndarray, most: int, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) of every row to at most ``most`` of its ``alive`` columns,
    nearest first; a column goes if ``ALPHA`` times its distance to a kept one is no
    more than the row's. ``between``: distances of the columns."""
    alive, left, right = alive.copy(), [], []
    i = np.arange(len(dist))
    for _ in range(most):
        masked = np.where(alive, dist, np.inf)
        pick = masked.argmin(axis=1)
        has = np.isfinite(masked[i, pick])
        if not has.any():
            break
        left.append(i[has])
        right.append(pick[has])
        alive &= ALPHA * between[pick] > dist
        alive[i, pick] = False
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def flat_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (from, to) among the rows of ``x`` (norm 1), and the entry points."""
    n = len(x)
    dist = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0)).astype(np.float32)
    others = ~np.eye(n, dtype=bool)
    a, b = robust_prune(dist, others, NEAR, dist)
    entry = np.sort(np.unique([np.argmax(x @ x.mean(axis=0)), *_central(x, max(1, n // PER_ENTRY))]))
    far = np.unique(np.concatenate([entry, np.arange(0, n, max(1, n // PER_ENTRY))]))
    c, d = robust_prune(dist[:, far], others[:, far], FAR, dist[np.ix_(far, far)])
    d = far[d]
    edges = np.unique(np.concatenate([a * n + b, b * n + a, c * n + d, d * n + c]))
    return edges // n, edges % n, entry


def _central(x: np.ndarray, k: int) -> list[int]:
    m, _ = medoids(x, k, 1.0)
    return np.argmax(x @ m.T, axis=0).tolist()


def _built(t: pa.Table) -> pa.Table:
    t = t.combine_chunks().sort_by("node")
    node = t.column("node").to_numpy()
    a, b, entry = flat_graph(unit_rows(t.column("x").combine_chunks()))
    offsets = np.searchsorted(a, np.arange(len(node) + 1))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(node[b], pa.int64()))
    first = np.isin(np.arange(len(node)), entry)
    return pa.table([*(t.column(c) for c in ("cell", "piece", "pieces", "node", "x")), lists, pa.array(first)],
                    names=["cell", "piece", "pieces", "node", "x", "next", "entry"])


def graph(dealt: DataFrame) -> DataFrame:
    """The graph of each piece: the rows of ``dealt`` with ``next`` and ``entry``."""
    kind = dealt.schema["x"].dataType.simpleString()
    return dealt.select("cell", "piece", "pieces", "node", "x").groupBy("cell", "piece").applyInArrow(
        _built, f"cell string, piece long, pieces long, node long, x {kind}, next array<long>, entry boolean")


# ------------------------------------------------------------------------- search
class Piece:
    """A piece's vectors with the united adjacency lists, as far as they lead to its nodes."""

    def __init__(self, t: pa.Table) -> None:
        t = t.combine_chunks().sort_by("node")
        self.node = t.column("node").to_numpy()
        self.x, self.norm = vectors(t.column("x").combine_chunks())
        self.size = t.column("size").to_numpy()
        self.homes = t.column("homes").to_pylist()
        self.entry = np.flatnonzero(t.column("entry").to_numpy(zero_copy_only=False))
        lists = t.column("next").combine_chunks()
        to = lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(self.node, to), len(self.node) - 1)
        here = self.node[place] == to
        owner = np.repeat(np.arange(len(self.node)), lists.value_lengths().to_numpy())[here]
        self.to = place[here]
        self.begin = np.searchsorted(owner, np.arange(len(self.node) + 1))

    def next(self, q: np.ndarray, at: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, neighbour of ``at``) not seen before, each once."""
        n = self.begin[at + 1] - self.begin[at]
        where = np.repeat(self.begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        flat = np.repeat(q, n) * len(self.node) + self.to[where]
        flat = np.unique(flat[~seen.ravel()[flat]])
        seen.ravel()[flat] = True
        return flat // len(self.node), flat % len(self.node)

    def cosine(self, x: np.ndarray, norm: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for i in range(0, len(q), PAIRS):
            a, b = q[i:i + PAIRS], at[i:i + PAIRS]
            out[i:i + PAIRS] = np.einsum("ij,ij->i", x[a], self.x[b]) / (norm[a] * self.norm[b])
        return out

    def search(self, x: np.ndarray, norm: np.ndarray, own: np.ndarray, bound: float, slack: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Links (query, node) with a cosine of ``bound`` or more. ``own``: the query's own
        place in the piece or -1. Also how many queries did not find themselves."""
        n_q, n = len(x), len(self.node)
        seen = np.zeros((n_q, n), dtype=bool)
        every = np.arange(n_q)
        q, at = np.repeat(every, len(self.entry)), np.tile(self.entry, n_q)
        seen[:, self.entry] = True
        cos = self.cosine(x, norm, q, at)
        found = [(q, at, cos)]
        # greedy: the best of the beam is opened until all of it is
        beam_at = np.full((n_q, BEAM), -1)
        beam_cos = np.full((n_q, BEAM), -np.inf)
        opened = np.zeros((n_q, BEAM), dtype=bool)
        while True:
            self._into(beam_at, beam_cos, opened, q, at, cos)
            ready = np.where(opened | (beam_at < 0), -np.inf, beam_cos)
            best = ready.argmax(axis=1)
            go = np.isfinite(ready[every, best])
            go &= ~((own >= 0) & seen[every, own])  # at its own place
            act = np.flatnonzero(go)
            if not len(act):
                break
            opened[act, best[act]] = True
            q, at = self.next(act, beam_at[act, best[act]], seen)
            cos = self.cosine(x, norm, q, at)
            found.append((q, at, cos))
        lost = np.flatnonzero((own >= 0) & ~seen[every, own])
        if len(lost):
            seen[lost, own[lost]] = True
            found.append((lost, own[lost], np.ones(len(lost))))
        # range: what lies within it is opened until nothing new does
        q, at, cos = (np.concatenate(c) for c in zip(*found))
        wide = cos >= bound - slack
        found = [(q[cos >= bound], at[cos >= bound])]
        q, at = q[wide], at[wide]
        while len(q):
            q, at = self.next(q, at, seen)
            cos = self.cosine(x, norm, q, at)
            found.append((q[cos >= bound], at[cos >= bound]))
            wide = cos >= bound - slack
            q, at = q[wide], at[wide]
        q, at = (np.concatenate(c) for c in zip(*found))
        other = at != own[q]
        return q[other], at[other], len(lost)

    @staticmethod
    def _into(beam_at, beam_cos, opened, q, at, cos) -> None:
        """The best of the beam and of new pairs (sorted by query) into the beam."""
        if not len(q):
            return
        who, first, n = np.unique(q, return_index=True, return_counts=True)
        col = np.arange(len(q)) - np.repeat(first, n)
        row = np.repeat(np.arange(len(who)), n)
        new_at, new_cos = np.full((len(who), n.max()), -1), np.full((len(who), n.max()), -np.inf)
        new_at[row, col], new_cos[row, col] = at, cos
        at_, cos_ = np.hstack([beam_at[who], new_at]), np.hstack([beam_cos[who], new_cos])
        open_ = np.hstack([opened[who], np.zeros(new_at.shape, dtype=bool)])
        top = np.argsort(-cos_, axis=1, kind="stable")[:, :BEAM]
        pick = np.arange(len(who))[:, None], top
        beam_at[who], beam_cos[who], opened[who] = at_[pick], cos_[pick], open_[pick]


def _codes(homes: list[list[str]], names: dict[str, int]) -> np.ndarray:
    out = np.full((len(homes), max((len(h) for h in homes), default=1)), -1)
    for i, h in enumerate(homes):
        out[i, :len(h)] = [names[c] for c in h]
    return out


def _first_common(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """Whether ``cell`` is the least number that both rows of each pair have."""
    least = np.full(len(a), np.iinfo(np.int64).max)
    for i in range(a.shape[1]):
        same = (a[:, i, None] == b).any(axis=1) & (a[:, i] >= 0)
        least = np.where(same, np.minimum(least, a[:, i]), least)
    return least == cell


def _searched(bound: float):
    """Sorted by cell and piece: its nodes, then foreign queries (nodes of other pieces).
    Out come, by ``kind``, counts of links (0: node, links), edges between linked nodes
    (1: node, other) and audits (2: links found, links there are; 3: queries, lost ones)."""
    def links(p: Piece, cell: str, q: pa.Table, foreign: bool) -> Iterator[tuple]:
        x, norm = vectors(q.column("x").combine_chunks())
        node, rep, homes = q.column("node").to_numpy(), q.column("rep").to_pylist(), q.column("homes").to_pylist()
        own = np.full(len(node), -1) if foreign else np.searchsorted(p.node, node)
        test = np.array([i for i, r in enumerate(rep) if r is not None and r % AUDIT == 0], dtype=np.int64)
        slack = SLACK
        while True:
            found, lost = [], 0
            for i in range(0, len(node), QUERIES):
                a, b, n = p.search(x[i:i + QUERIES], norm[i:i + QUERIES], own[i:i + QUERIES], bound, slack)
                found.append((a + i) * len(p.node) + b)
                lost += n
            pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]))
            if not foreign:  # found from either side
                a, b = pairs // len(p.node), pairs % len(p.node)
                pairs = np.unique(np.concatenate([pairs, b * len(p.node) + a]))
            there = hit = 0
            for i in range(0, len(test), QUERIES):  # brute force for the audited queries
                some = test[i:i + QUERIES]
                a, b = np.nonzero((x[some] / norm[some, None]) @ (p.x / p.norm[:, None]).T >= bound - 1e-9)
                a = some[a]
                real = (b != own[a]) & (p.cosine(x, norm, a, b) >= bound)
                there += int(real.sum())
                hit += int(np.isin(a[real] * len(p.node) + b[real], pairs).sum())
            if hit == there or slack > 1:
                break
            slack *= 2
        a, b = pairs // len(p.node), pairs % len(p.node)
        names = {c: i for i, c in enumerate(sorted({c for h in homes for c in h} | {c for h in p.homes for c in h}))}
        mine, theirs = _codes(homes, names), _codes(p.homes, names)
        count = np.zeros(len(node), dtype=np.int64)
        for i in range(0, len(a), PAIRS):
            s, t = a[i:i + PAIRS], b[i:i + PAIRS]
            counts = _first_common(mine[s], theirs[t], names[cell])
            np.add.at(count, s[counts], p.size[t[counts]])
        has = np.flatnonzero(count)
        yield 0, node[has], count[has]
        yield from spanning(np.concatenate([p.node, node]) if foreign else node, a + len(p.node) if foreign else a, b)
        yield 2, np.array([hit]), np.array([there])
        yield 3, np.array([len(node)]), np.array([lost])

    def spanning(node, a, b):
        """An edge from each node to the first one that the pairs join it to."""
        root = np.arange(len(node))
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        apart = np.flatnonzero(root != np.arange(len(node)))
        yield 1, node[apart], node[root[apart]]

    def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for kind, a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             names=["kind", "node", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = piece = None
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))  # cell, piece, foreign
            begin = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
            for lo, hi in zip(begin, begin[1:]):
                if keys[lo] != key:
                    if held:
                        piece = Piece(pa.Table.from_batches(held))
                        yield from rows(links(piece, key[0], pa.Table.from_batches(held).combine_chunks().sort_by("node"), False))
                        held = []
                    key = keys[lo]
                part = b.slice(lo, hi - lo)
                if key[2]:  # foreign queries stream, a batch at a time
                    for i in range(0, part.num_rows, ROWS):
                        yield from rows(links(piece, key[0], pa.Table.from_batches([part.slice(i, ROWS)]).combine_chunks(), True))
                else:
                    held.append(part)
        if held:
            piece = Piece(pa.Table.from_batches(held))
            yield from rows(links(piece, key[0], pa.Table.from_batches(held).combine_chunks().sort_by("node"), False))
    return run


def search(nodes: DataFrame, bound: float, rows: int = ROWS) -> DataFrame:
    """Rows of ``_searched`` over all ``nodes`` (``node``, ``label``, ``x``, ``size``, ``rep``)."""
    built = settle(graph(shards(nodes, bound, rows)), "graph")
    facts = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"),
                                      F.sort_array(F.collect_set("cell")).alias("homes")).join(nodes.select("node", "size", "rep"), "node")
    members = built.drop("next").join(facts, "node")
    cols = ["cell", "piece", "foreign", "node", "x", "size", "rep", "homes"]
    own = members.withColumn("foreign", F.lit(False)).select(*cols, "next", "entry")
    other = members.filter("pieces > 1").withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))) \
        .filter("of <> piece").withColumn("piece", F.col("of")).withColumn("foreign", F.lit(True)) \
        .select(*cols, F.lit(None).cast("array<long>").alias("next"), F.lit(None).cast("boolean").alias("entry"))
    in_order = own.union(other).repartition("cell", "piece").sortWithinPartitions("cell", "piece", "foreign", "node")
    return in_order.mapInArrow(_searched(bound), "kind int, node long, other long")


# ---------------------------------------------------------------------- operators
def _keyed(vectors_: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id``, ``label``, ``x`` and two hashes of both; null hashes where a vector
    links with nothing."""
    x = F.col("x")
    rows = vectors_.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                           F.transform(vector_col, lambda v: v + F.lit(0).cast("float")).alias("x"))  # no negative zero
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.col("label").isNotNull() & F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    return rows.withColumns({"one": F.when(good, F.xxhash64("label", "x")), "two": F.when(good, F.xxhash64("x", F.lit("two"), "label"))})


def _nodes(rows: DataFrame) -> DataFrame:
    first = rows.filter("one IS NOT NULL").groupBy("one", "two").agg(
        F.first("label").alias("label"), F.first("x").alias("x"), F.count("*").alias("size"), F.min("vec_id").alias("rep"))
    return settle(settle(first, "vectors").withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def near_duplicates(vectors_: DataFrame, bound: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", rows: int = ROWS) -> DataFrame:
    """Per vector ``vec_id``, ``n_links``, ``component_id`` (smallest identifier that links
    reach) and ``kept``."""
    keyed = _keyed(vectors_, id_col, vector_col, label_col)
    nodes = _nodes(keyed)
    found = settle(search(nodes, bound, rows), "vector-links")
    counts = found.filter("kind = 0").groupBy("node").agg(F.sum("other").alias("links"))
    roots = components(found.filter("kind = 1").select("node", "other"))
    rooted = nodes.select("node", "one", "two", "size", "rep").join(counts, "node", "left").join(roots, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("least")), "root") \
        .select("one", "two", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "least")
    out = keyed.select("vec_id", "one", "two").join(rooted, ["one", "two"], "left")
    least = F.when(F.col("one").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), least.alias("component_id"),
                      F.coalesce(F.col("vec_id") == least, F.lit(False)).alias("kept"))


def audit(vectors_: DataFrame, bound: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
          label_col: str = "label", rows: int = ROWS) -> DataFrame:
    """One row: ``found`` of ``links`` that brute force finds in the shards of the audited
    queries, ``searches``, and how many of them did not come to the query itself."""
    found = search(_nodes(_keyed(vectors_, id_col, vector_col, label_col)), bound, rows)
    total = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    return found.agg(total(2, "node").alias("found"), total(2, "other").alias("links"), total(3, "node").alias("searches"), total(3, "other").alias("lost"))


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
