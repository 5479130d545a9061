"""Graphs and senses of many lemmas stream by in sorted Arrow batches: no call per lemma, no row compared with a list, whatever the batches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from senseloom.functions.streams import whole_keys
from senseloom.operators import graph, senses, vectors


@pytest.fixture(params=[3, 10_000])
def small_batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def cleaned(spark):
    draw = random.Random(3)
    held = [(draw.choice(["x", "y", "é", "z"]), draw.sample("abcdefghij", draw.randint(1, 4)), draw.randint(1, 3)) for _ in range(60)] + [("alone", ["a"], 9)]
    return spark.createDataFrame(held, "lemma string, reps array<string>, times long")


def test_tables_hold_whole_keys():
    draw = random.Random(5)
    for _ in range(100):
        keys = sorted(draw.choices("abcdefg"[: draw.randint(1, 7)], k=draw.randint(0, 40)))
        batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + 3], pa.string())}) for i in range(0, len(keys) + 3, 3)]
        found = [t.column("k").to_pylist() for t in whole_keys(iter(batches), "k", 5)]
        assert sum(found, []) == keys and all(a[-1] != b[0] for a, b in zip(found, found[1:], strict=False))


def test_graphs_of_rows_equal_graphs_of_edges(spark, small_batches):
    held = cleaned(spark)
    edges = graph.edges(held)
    for least in (1, 4):
        found = graph.components(held, least, 3)
        assert rows(found, "lemma", "token", "community") == rows(graph.components(edges.where(F.col("w") >= least)), "lemma", "token", "community")
        assert set(rows(found, "lemma", "token", "cnt")) <= set(rows(graph.nodes(held), "lemma", "token", "cnt"))
        for algorithm in ("louvain", "leiden"):
            assert rows(graph.louvain(held, algorithm=algorithm, least=least), "lemma", "token", "community") == rows(graph.louvain(edges, algorithm=algorithm, least=least), "lemma", "token", "community")
    assert graph.components(held, 1000).count() == 0 and graph.components(held.limit(0)).count() == 0
    assert "FlatMapGroups" not in graph.components(held)._jdf.queryExecution().executedPlan().toString()


def test_an_inventory_takes_popularity_from_communities(spark):
    held = cleaned(spark)
    known = graph.components(held, 4)
    columns = ("lemma", "sense_id", "rank", "token", "cnt")
    assert rows(senses.inventory(held, known, 1), *columns) == rows(senses.inventory(held, known.drop("cnt"), 1), *columns) != []


def test_senses_meet_rows_of_their_lemma(spark, small_batches):
    draw = random.Random(4)
    lemmas, tokens = ["cat", "dog", "bird", "none", "the"], [f"t{i}" for i in range(12)]
    inventory = [(lemma, s, r + 1, t, 1) for lemma in lemmas[:3] for s in range(3) for r, t in enumerate(draw.sample(tokens, draw.randint(1, 5)))]
    asked = [(draw.choice(lemmas), i, i % 7, draw.sample(tokens, draw.randint(1, 6))) for i in range(80)]
    want = []
    for lemma, f, p, reps in asked:
        sets = {s: {t for k, x, _, t, _ in inventory if (k, x) == (lemma, s)} for s in range(3)}
        shared = {s: len(set(reps[:4]) & held) for s, held in sets.items()}
        best = [(n / (len(reps[:4]) + len(sets[s]) - n), -s, n) for s, n in shared.items() if n]
        if best:
            score, down, n = max(best)
            want.append((lemma, f, p, -down, n, len(reps[:4]) + len(sets[-down]) - n, score))
    near, listed = spark.createDataFrame(asked, "lemma string, file_id long, pos long, reps array<string>"), spark.createDataFrame(inventory, "lemma string, sense_id long, rank long, token string, cnt long")
    found = senses.assign(near, listed, 4)
    assert rows(found, "lemma", "file_id", "pos", "sense_id", "shared", "total", "score") == sorted(want)
    assert senses.assign(near, listed.limit(0)).count() == 0
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_small_graphs_are_partitioned_once_and_steps_hold_plain_numbers():
    calls = []

    def method(n, u, v, w):
        calls.append(n)
        return np.arange(n) % 2

    lemma, u, v = np.repeat(np.arange(50), 3), np.repeat(np.arange(0, 150, 3), 2), np.arange(150)[np.arange(150) % 3 > 0]
    home = graph._one_by_one(method)(lemma, u, v, np.ones(100))
    assert len(calls) == 1 and home.tolist() == [3 * i + x for i in range(50) for x in (0, 1, 0)]
    near = graph._start(3, np.array([0, 0]), np.array([1, 2]), np.array([1, 2]))
    home = graph._move(near, graph._degrees(near), 3.0, 1.0, np.arange(3))
    assert near == [{1: 1.0, 2: 2.0}, {0: 1.0}, {0: 2.0}] and {type(x) for x in [*home, *near[0], *near[0].values(), *graph._degrees(near)]} == {int, float}


def plain_linkage(x, most):
    """Average linkage by its definition: the two clusters of least mean distance merge."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, clusters, heights, found = 1 - unit @ unit.T, [[i] for i in range(len(x))], [], []
    while len(clusters) > 1:
        h, a, b = min((d[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(clusters) for j, q in enumerate(clusters) if i < j)
        clusters = [sorted(clusters[a] + clusters[b]), *(c for k, c in enumerate(clusters) if k not in (a, b))]
        heights.append(h)
        found.append({tuple(c) for c in clusters})
    cut = heights[-min(most, len(x) - 1)]
    return found[max(k for k, h in enumerate(heights) if h <= cut + 1e-12)]


def test_average_linkage_of_rows_that_come_again():
    draw = np.random.default_rng(2)
    for k in range(60):
        x = draw.random((draw.integers(2, 9), 5))
        x = x[draw.integers(0, len(x), 2 * len(x))] if k % 2 else x
        for most in (1, 3, 7):
            label = vectors.average_linkage(x, most)
            assert {tuple(np.flatnonzero(label == c)) for c in set(label)} == plain_linkage(x, most)


def test_clusters_of_many_lemmas_stream_by(spark, small_batches):
    held = spark.createDataFrame([(lemma, f, 0, ["a", "b"] if f % 3 else ["c", lemma]) for lemma in "xyz" for f in range(7)] + [("one", 1, 2, ["a"])], "lemma string, file_id long, pos long, reps array<string>")
    found = vectors.hac_senses(held, 2)
    assert rows(found, "lemma", "file_id", "pos", "cluster") == [("one", 1, 2, 0)] + [(lemma, f, 0, 0 if f % 3 else 1) for lemma in "xyz" for f in range(7)]
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
