"""Substitute co-occurrence graphs, one per lemma, and their partitions."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate
from math import exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from senseloom.functions.streams import coded, whole_keys
from senseloom.operators.text import first_rows

SEED = 111
PARTITION = "lemma string, token string, community long, cnt long"
#: Edges of the largest graph whose labels are remembered, and how many graphs' are: most lemmas have one of a few small graphs.
REMEMBERED_EDGES, REMEMBERED = 64, 20_000


def edges(cleaned: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (lemma, u, v, w) with u < v: in how many instances of the lemma both are substitutes. ``cleaned`` may have ``times``, the instances that a row stands for.

    Rows are dealt by lemma before they become pairs (at most n_reps squared over two each): a row is much smaller than its pairs, and a lemma's rows are bounded by the sample of its instances.
    As pairs take much more room than what is dealt, ``parts`` fixes the number of partitions, which would else follow from the rows' size.
    """
    pairs = F.flatten(F.transform("reps", lambda x, i: F.transform(F.slice("reps", i + 2, F.size("reps")), lambda y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")))))
    return _by_times(cleaned, parts).select("lemma", "times", F.explode(pairs).alias("p")).groupBy("lemma", "p.u", "p.v").agg(F.sum("times").alias("w"))


def nodes(cleaned: DataFrame) -> DataFrame:
    """Rows (lemma, token, cnt): in how many instances of the lemma the substitute occurs (its popularity). ``cleaned`` may have ``times``, as in :func:`edges`."""
    return _by_times(cleaned).select("lemma", "times", F.explode("reps").alias("token")).groupBy("lemma", "token").agg(F.sum("times").alias("cnt"))


def _by_times(cleaned: DataFrame, parts: int | None = None) -> DataFrame:
    times = F.col("times") if "times" in cleaned.columns else F.lit(1).cast("long")
    return cleaned.select("lemma", "reps", times.alias("times")).repartition(*([parts] if parts else []), "lemma")


def degrees(edges: DataFrame) -> DataFrame:
    """Rows (lemma, token, degree)."""
    ends = edges.select("lemma", F.explode(F.array("u", "v")).alias("token"))
    return ends.groupBy("lemma", "token").agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` nodes of highest degree of each lemma, ties by token."""
    return first_rows(degrees(edges), ["lemma"], [F.desc("degree"), "token"], n)


Labels = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _pairs(t: pa.Table, place: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of nodes in a row's ``reps`` and their times; ``of`` are the rows' nodes one after the other, ``place`` each one's place from its row's end."""
    times = np.repeat(t.column("times").to_numpy(), pc.list_value_length(t.column("reps").combine_chunks()).to_numpy())
    at = [np.flatnonzero(place >= d) for d in range(1, place.max(initial=0) + 1)]
    one, other = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([of[a] for a in at], [of[a + d] for d, a in enumerate(at, 1)]))
    return np.minimum(one, other), np.maximum(one, other), np.concatenate([np.zeros(0, np.int64), *(times[a] for a in at)])


def _partitions(t: pa.Table, label: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], least: int) -> pa.Table:
    """The communities of the graphs of some whole lemmas at once: nodes are numbered by lemma and name, so a lemma's are consecutive and no edge leaves it."""
    lemma, lemmas = coded(t.column("lemma"))
    if by_rows := "reps" in t.column_names:
        held = t.column("reps").combine_chunks()
        token, names = coded(held.flatten())
        n = pc.list_value_length(held).to_numpy()
        node, of = np.unique(np.repeat(lemma, n) * len(names) + token, return_inverse=True)
        u, v, w = _pairs(t, np.repeat(np.cumsum(n), n) - np.arange(len(of)) - 1, of)
        cnt = np.bincount(of, np.repeat(t.column("times").to_numpy(), n), len(node))
    else:
        token, names = coded(pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks], pa.string()))
        node, of = np.unique(np.tile(lemma, 2) * len(names) + token, return_inverse=True)
        u, v, w = of[: len(t)], of[len(t) :], t.column("w").to_numpy()
    edge, at = np.unique(u * len(node) + v, return_inverse=True)
    w = np.bincount(at, w, len(edge))
    edge, w = edge[w >= least], w[w >= least]
    used, of = np.unique(np.concatenate([edge // max(1, len(node)), edge % max(1, len(node))]), return_inverse=True)
    node = node[used]
    home = label(node // max(1, len(names)), of[: len(edge)], of[len(edge) :], w)
    # A community is numbered by its first node in the order of names, from 0 in each lemma.
    _, first, of = np.unique(home, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    _, start, owner = np.unique(node // max(1, len(names)), return_index=True, return_inverse=True)
    number = rank[of]
    number -= number[start][owner]
    counts = pa.array(cnt[used].astype(np.int64)) if by_rows else pa.nulls(len(node), pa.int64())
    return pa.table({"lemma": lemmas.take(pa.array(node // max(1, len(names)))), "token": names.take(pa.array(node % max(1, len(names)))), "community": number, "cnt": counts})


def _by_lemma(graphs: DataFrame, label: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], least: int, parts: int | None) -> DataFrame:
    """Partition each lemma's graph, many lemmas in a step: (lemma, token, community, cnt). ``graphs`` are edges (lemma, u, v, w), which are of no known ``cnt``, or cleaned rows as :func:`edges` takes them, whose pairs are made in the task.

    Edges of less than ``least`` are left out. Rows are dealt by lemma and stream by; a lemma's are bounded by the sample of its instances.
    """
    rows = _by_times(graphs, parts) if "reps" in graphs.columns else graphs.select("lemma", "u", "v", "w").repartition(*([parts] if parts else []), "lemma")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, "lemma"):
            yield from _partitions(t, label, least).to_batches()

    return rows.sortWithinPartitions("lemma").mapInArrow(each, PARTITION)


def _one_by_one(method: Labels) -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """``method`` for the graph of each lemma on its own. Labels follow from a graph's numbers alone, so small graphs that come again have theirs already."""
    known: dict[tuple[int, bytes, bytes, bytes], np.ndarray] = {}

    def label(lemma: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        home = np.empty(len(lemma), np.int64)
        starts = np.r_[np.flatnonzero(np.r_[True, lemma[1:] != lemma[:-1]]), len(lemma)] if len(lemma) else np.zeros(1, int)
        cuts = np.searchsorted(u, starts)  # edges are in the order of their first node
        for a, b, i, j in zip(starts[:-1], starts[1:], cuts[:-1], cuts[1:], strict=True):
            graph = b - a, u[i:j] - a, v[i:j] - a, w[i:j]
            key = (graph[0], *(x.tobytes() for x in graph[1:])) if j - i <= REMEMBERED_EDGES else None
            if (found := known.get(key)) is None:
                found = method(*graph)
                if key and len(known) < REMEMBERED:
                    known[key] = found
            home[a:b] = found + a
        return home

    return label


def component_labels(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(graphs: DataFrame, least: int = 1, parts: int | None = None) -> DataFrame:
    """Connected components of each lemma's graph: (lemma, token, community), communities numbered by their first token, and ``cnt``, a node's popularity, from cleaned rows. See :func:`_by_lemma` for ``graphs``."""
    found = _by_lemma(graphs, lambda lemma, u, v, w: component_labels(len(lemma), u, v, w), least, parts)
    return found if "reps" in graphs.columns else found.drop("cnt")


def modularity(label: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float = 1.0) -> float:
    total = w.sum()
    degree = np.bincount(np.concatenate([u, v]), np.concatenate([w, w]), len(label))
    inside = w[label[u] == label[v]].sum() / total
    return inside - resolution * ((np.bincount(label, degree) / (2 * total)) ** 2).sum()


def _move(near: list[dict[int, float]], degree: list[float], total: float, resolution: float, order: np.ndarray, home: list[int] | None = None) -> list[int]:
    """One level of local moving from ``home`` (by default each node alone): every node joins the neighbouring community of greatest gain until none gains.

    Here and below nodes are plain numbers in lists: a graph's steps are too small for arrays.
    """
    home = list(range(len(near))) if home is None else list(home)
    weight = [0.0] * len(near)
    for h, d in zip(home, degree, strict=True):
        weight[h] += d
    order, twice, moved = order.tolist(), 2 * total, True
    while moved:
        moved = False
        for i in order:
            own, d = home[i], degree[i]
            weight[own] -= d
            links: dict[int, float] = {}
            for j, w in near[i].items():
                if j != i:
                    c = home[j]
                    links[c] = links.get(c, 0.0) + w
            d_own = resolution * d
            best, most = own, links.get(own, 0.0) - d_own * weight[own] / twice
            for c in sorted(links):
                gain = links[c] - d_own * weight[c] / twice
                if gain > most + 1e-12:
                    best, most = c, gain
            if best != own:
                moved, home[i] = True, best
            weight[best] += d
    return home


def _refine(near: list[dict[int, float]], degree: list[float], total: float, resolution: float, home: list[int] | np.ndarray, rng: np.random.RandomState, heat: float = 0.01) -> np.ndarray:
    """Split each community of ``home`` into parts that hang together: from single nodes on, a node that is still alone may join a part of its own community.

    Both the node and the part must be well connected to the rest of the community, and the join must not lower the quality. Among such parts one is drawn, the likelier
    the more it gains; so parts grow along edges only and are connected.
    """
    n, twice, warmth, home = len(near), 2 * total, heat * total, np.asarray(home).tolist()
    part, members, weight = list(range(n)), [1] * n, list(degree)
    whole = [0.0] * n
    for h, d in zip(home, degree, strict=True):
        whole[h] += d
    outward = [sum(w for j, w in x.items() if j != i and home[j] == home[i]) for i, x in enumerate(near)]  # of a part, to the rest of its community
    for i in rng.permutation(n).tolist():
        own, d = home[i], degree[i]
        if part[i] != i or members[i] > 1 or outward[i] < resolution * d * (whole[own] - d) / twice - 1e-12:
            continue
        links: dict[int, float] = {}
        for j, w in near[i].items():
            if j != i and home[j] == own:
                links[part[j]] = links.get(part[j], 0.0) + w
        gains = {}
        for p in sorted(links):
            if outward[p] >= resolution * weight[p] * (whole[own] - weight[p]) / twice - 1e-12 and (gain := links[p] - resolution * d * weight[p] / twice) > 0:
                gains[p] = gain
        if not gains:
            continue
        most = max(gains.values())
        odds = list(accumulate(exp((g - most) / warmth) for g in gains.values()))
        p = list(gains)[min(bisect_right(odds, rng.random_sample() * odds[-1]), len(odds) - 1)]
        outward[p] += outward[i] - 2 * links[p]
        weight[p] += d
        members[p], members[i], part[i] = members[p] + 1, 0, p
    return np.array(part)


def _merged(near: list[dict[int, float]], home: list[int]) -> list[dict[int, float]]:
    """The graph of the communities ``home`` (numbered from 0 without gaps); edges inside one become its loop."""
    merged: list[dict[int, float]] = [defaultdict(float) for _ in range(max(home) + 1)]
    for i, x in enumerate(near):
        own = merged[home[i]]
        for j, value in x.items():
            own[home[j]] += value if i == j or home[i] != home[j] else value / 2
    return merged


def _start(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[dict[int, float]]:
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    for a, b, x in zip(u.tolist(), v.tolist(), w.astype(float).tolist(), strict=True):
        near[a][b] += x
        near[b][a] += x
    return near


def _degrees(near: list[dict[int, float]]) -> list[float]:
    return [sum(x.values()) + x.get(i, 0.0) for i, x in enumerate(near)]


def _without_gaps(home: list[int]) -> list[int]:
    """Numbers from 0 on in the same order."""
    number = {h: i for i, h in enumerate(sorted(set(home)))}
    return [number[h] for h in home]


def louvain_labels(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = SEED, refine: bool = False) -> np.ndarray:
    """Louvain communities: local moving, then the same on the graph of communities, until nothing moves; with ``refine`` those of :func:`leiden_labels`."""
    if refine:
        return leiden_labels(n, u, v, w, resolution, seed)
    rng = np.random.RandomState(seed)
    label, total, near = np.arange(n), float(w.sum()), _start(n, u, v, w)
    while True:
        home = _without_gaps(_move(near, _degrees(near), total, resolution, rng.permutation(len(near))))
        if max(home) + 1 == len(near):
            return label
        label, near = np.array(home)[label], _merged(near, home)


def _leiden_pass(graph: list[dict[int, float]], total: float, resolution: float, rng: np.random.RandomState, label: np.ndarray) -> np.ndarray:
    """One pass from the communities ``label``: local moving, refinement, and the same on the graph of refined parts, which starts from the unrefined communities."""
    near, home, of = graph, label.tolist(), np.arange(len(graph))  # of: each node's place in ``near``
    while True:
        degree = _degrees(near)
        home = _move(near, degree, total, resolution, rng.permutation(len(near)), home)
        if len(set(home)) == len(near):
            return np.array(_without_gaps(home))[of]
        part = _refine(near, degree, total, resolution, home, rng).tolist()
        if len(set(part)) == len(near):  # nothing joined: connected parts instead, so that the pass ends
            pairs = [(i, j) for i, x in enumerate(near) for j in x if i < j and home[i] == home[j]]
            a, b = (np.array(x, int) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
            part = component_labels(len(near), a, b, np.ones(len(a))).tolist()
            if len(set(part)) == len(near):
                return np.arange(len(near))[of]
        part = _without_gaps(part)
        first = dict(zip(reversed(part), reversed(home), strict=True))  # the community of each part's first node
        near, of = _merged(near, part), np.array(part)[of]
        home = _without_gaps([first[p] for p in range(len(first))])


def leiden_labels(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = SEED, patience: int = 4) -> np.ndarray:
    """Leiden communities: passes of moving, refinement and aggregation, each from the best result so far, until ``patience`` passes in a row gain no modularity.

    Every community is connected. The first pass starts from single nodes, the second idle one from Louvain's communities, so their modularity is never missed.
    """
    rng = np.random.RandomState(seed)
    total, near = float(w.sum()), _start(n, u, v, w)
    label = _leiden_pass(near, total, resolution, rng, np.arange(n))
    best, idle, other = modularity(label, u, v, w, resolution), 0, None
    while idle < patience:
        if idle == 1 and other is None:
            other = louvain_labels(n, u, v, w, resolution, seed)
        new = _leiden_pass(near, total, resolution, rng, other if idle == 1 else label)
        if (reached := modularity(new, u, v, w, resolution)) > best + 1e-12:
            label, best, idle = new, reached, 0
        else:
            idle += 1
    return label


def louvain(graphs: DataFrame, resolution: float = 1.0, seed: int = SEED, algorithm: str = "louvain", least: int = 1, parts: int | None = None) -> DataFrame:
    """Communities of each lemma's graph by Louvain (or "leiden"): (lemma, token, community). See :func:`_by_lemma` for ``graphs``."""
    if algorithm not in ("louvain", "leiden"):
        raise ValueError(f"unknown community algorithm {algorithm}")
    labels = louvain_labels if algorithm == "louvain" else leiden_labels
    return _by_lemma(graphs, _one_by_one(lambda n, u, v, w: labels(n, u, v, w, resolution, seed)), least, parts).drop("cnt")
