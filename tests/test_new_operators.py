"""Leiden, batches, greedy inference, fuzzy B-cubed, query-word variants, CBOW, runs by method and the stored index, against plain versions."""

import contextlib
import io
import itertools
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from senseloom.functions.arrays import two_decimals
from senseloom.operators import batches, cbow, evaluation, graph, index, link, runs, senses, substitutes

DATA = Path("/root/testdata/sf0.001")


def made_graph(seed):
    """Blocks with more edges inside than between; seed 1569 makes one whose Louvain communities do not all hang together."""
    rng = np.random.default_rng(seed)
    k, size = int(rng.integers(3, 9)), int(rng.integers(3, 8))
    g = np.repeat(np.arange(k), size)
    inside, between = rng.uniform(0.2, 0.9), rng.uniform(0.01, 0.25)
    x, y = np.triu_indices(k * size, 1)
    keep = rng.random(len(x)) < np.where(g[x] == g[y], inside, between)
    u, v = x[keep], y[keep]
    return k * size, u, v, rng.choice([1.0, 1.0, 2.0, 5.0, 9.0], len(u))


def hang_together(label, n, u, v):
    inside = label[u] == label[v]
    parts = graph.component_labels(n, u[inside], v[inside], np.ones(inside.sum()))
    return len(np.unique(parts)) == len(np.unique(label))


def test_leiden_communities_hang_together():
    assert not hang_together(graph.louvain_labels(*made_graph(1569), 0.5), *made_graph(1569)[:3])
    assert hang_together(graph.leiden_labels(*made_graph(1569), 0.5), *made_graph(1569)[:3])
    for seed in range(60):
        n, u, v, w = made_graph(seed)
        if len(u):
            label = graph.leiden_labels(n, u, v, w)
            assert hang_together(label, n, u, v)
            assert graph.modularity(label, u, v, w) >= graph.modularity(graph.louvain_labels(n, u, v, w), u, v, w) - 1e-9
            assert (label == graph.leiden_labels(n, u, v, w)).all()


def test_refined_parts_lie_inside_communities_and_hang_together():
    for seed in range(40):
        n, u, v, w = made_graph(seed)
        if not len(u):
            continue
        near = graph._start(n, u, v, w)
        home = np.random.default_rng(seed).integers(0, 3, n)
        part = graph._refine(near, graph._degrees(near), float(w.sum()), 1.0, home, np.random.RandomState(seed))
        assert all(len(set(home[part == p])) == 1 for p in np.unique(part))
        assert hang_together(part, n, u, v)


def test_length_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(s)) for i, s in enumerate(np.r_[rng.integers(1, 60, 700), np.full(900, 20), [5000, 0, 0, 4999]])] + [(7, 33), (None, 4), (9999, None)]
    frame = spark.createDataFrame(rows, "id long, size int")
    found = batches.length_batches(frame.repartition(5), "id", F.col("size"), 1000, range_rows=100).collect()
    assert Counter((r["id"], r["size"]) for r in found) == Counter((i, s or 0) for i, s in rows)
    by = {}
    for r in found:
        by.setdefault(r["batch"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for group in by.values():
        assert len(group) == 1 or max(r["size"] for r in group) * len(group) <= 1000
        assert sorted(r["place"] for r in group) == list(range(len(group)))
    # In order of batches noisy lengths ascend, and they are near the lengths.
    ends = [(min(r["noisy"] for r in by[b]), max(r["noisy"] for r in by[b])) for b in sorted(by)]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(ends))
    assert all(abs(r["noisy"] - r["size"]) <= 0.1 * r["size"] + 1 for r in found)
    assert len(by) < 90  # greedy batches are nearly full
    again = batches.length_batches(frame.repartition(2), "id", F.col("size"), 1000, range_rows=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert batches.length_batches(frame.limit(0), "id", F.col("size")).count() == 0


def made_inventory(spark, words, senses_each, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for w in range(words):
        for s in range(senses_each):
            for rank, t in enumerate(rng.choice(40, 8, replace=False)):
                rows.append((f"w{w}", s, rank + 1, f"t{t}", 9 - rank))
    return spark.createDataFrame(rows, "lemma string, sense_id long, rank long, token string, cnt long"), rows


def test_greedy_inference(spark):
    inventory, rows = made_inventory(spark, 10, 4)
    words = [f"w{i}" for i in range(3)]
    exact = sorted(((-round(r["score"], 9), r["senses"]) for r in link.infer_by_list(inventory, words).collect()))
    whole = sorted(((-round(r["score"], 9), r["senses"]) for r in link.infer_greedily(inventory, [*words, "unknown"], beam=64).collect()))
    assert [x[0] for x in whole] == [x[0] for x in exact] and {frozenset(x[1].split()) for x in whole} == {frozenset(x[1].split()) for x in exact}

    sets = {}
    for lemma, s, _, t, _ in rows:
        sets.setdefault((lemma, s), {lemma}).add(t)
    groups = [((), 0.0)]
    for w in range(10):  # a plain beam
        grown = [((*g, (f"w{w}", s)), score + sum(len(sets[x] & sets[f"w{w}", s]) / len(sets[x] | sets[f"w{w}", s]) for x in g)) for g, score in groups for s in range(4)]
        groups = sorted(grown, key=lambda x: (-round(x[1], 9), " ".join(f"{a}_{b}" for a, b in x[0])))[:5]
    found = link.infer_greedily(inventory, [f"w{i}" for i in range(10)], beam=5).collect()
    assert sorted((r["senses"], round(r["score"], 9)) for r in found) == sorted((" ".join(f"{a}_{b}" for a, b in g), round(s, 9)) for g, s in groups)
    assert link.infer_greedily(inventory, ["unknown"]).count() == 0


def test_links_are_stored_and_read(spark, tmp_path):
    inventory, _ = made_inventory(spark, 6, 2)
    links = link.closest(link.signatures(inventory))
    link.store_links(links, f"{tmp_path}/links")
    columns = ("sense", "neighbour", "score", "rank")
    assert sorted(link.read_links(spark, f"{tmp_path}/links").select(*columns).collect()) == sorted(links.select(*columns).collect())


def test_fuzzy_b_cubed(spark):
    rng = np.random.default_rng(2)
    rows, soft = [[], []], [{}, {}]
    for word, n in (("a", 30), ("b", 12), ("lone", 1)):
        for i in range(n):
            for k in range(2):
                labels = rng.choice(["x", "y", "z", "u"], rng.integers(1, 4), replace=False)
                weights = rng.integers(1, 4, len(labels))
                rows[k] += [(word, i, str(c), float(w)) for c, w in zip(labels, weights, strict=True)]
                soft[k][word, i] = dict(zip(map(str, labels), weights / weights.sum(), strict=True))
    rows[0] += [("a", 999, "x", 1.0)]  # in gold alone
    frames = [spark.createDataFrame(r, "word string, item long, label string, weight double") for r in rows]
    overlap = lambda s, a, b: sum(min(s[a][c], s[b].get(c, 0)) for c in s[a])
    for r in evaluation.fuzzy_b_cubed(*frames).collect():
        items = [k for k in soft[1] if k[0] == r["word"]]
        means = []
        for base, other in ((soft[1], soft[0]), (soft[0], soft[1])):
            per = []
            for i in items:
                near = [j for j in items if j != i and overlap(base, i, j) > 0]
                if near:
                    per.append(np.mean([min(overlap(base, i, j), overlap(other, i, j)) / overlap(base, i, j) for j in near]))
            means.append(np.mean(per) if per else 0.0)
        assert (r["precision"], r["recall"]) == pytest.approx(means)
        assert r["f_score"] == pytest.approx(2 * means[0] * means[1] / sum(means) if sum(means) else 0.0)


def test_query_word_variants(spark):
    lemmas = {"play": "play", "plays": "play", "aplay": "plays", "zplay": "plays", "zz": "zplay", "Run": "Run", "run": "run", "running": "run", "Runs": "Run", "other": "other"}
    vocab = spark.createDataFrame(list(lemmas.items()), "token string, lemma string")
    found = {}
    for r in substitutes.query_variants(spark.createDataFrame([("Play",), ("PLAY",), ("run",), ("Running",), ("nothing",)], "word string"), vocab).collect():
        found.setdefault(r["word"], set()).add(r["token"])

    def plain(word):
        out = {x for x in (word, word.lower(), word.title()) if x in lemmas}
        for token in sorted(lemmas):
            if lemmas[token] in out:
                out.add(token)
        return out

    assert found == {w: plain(w) for w in ("Play", "PLAY", "run", "Running")}
    assert found["PLAY"] == {"play", "plays", "zplay", "zz"} and found["Running"] == {"running"}
    frame = spark.createDataFrame([(1, "Play", ["play", "game", "zplay"], [0.5, 0.3, 0.2]), (2, "run", ["Runs", "run"], [0.6, 0.4]), (3, "nothing", ["play"], [1.0])], "id long, word string, reps array<string>, probs array<double>")
    rows = substitutes.without_words(frame, substitutes.query_variants(frame.select("word"), vocab), "word").orderBy("id").collect()
    assert [(r["id"], r["reps"], r["probs"]) for r in rows] == [(1, ["game"], [0.3]), (3, ["play"], [1.0])]


def test_cbow_puts_planted_synonyms_together(spark):
    rng = np.random.default_rng(4)
    themes = [[f"{a}{i}" for i in range(6)] for a in "abcd"]
    sentences = []
    for _ in range(900):
        theme = themes[rng.integers(4)]
        words = list(rng.choice(theme, 7))
        words[int(rng.integers(7))] = f"syn{theme[0][0]}{rng.integers(2)}"  # two synonyms for each theme
        sentences.append(([str(w) for w in words],))
    frame = spark.createDataFrame([*sentences, (None,), ([],), (["rare"],)], "words array<string>")
    rows = cbow.cbow(frame.repartition(3), size=20, epochs=15, parts=4, rate=0.05, frequent=1.0).collect()
    vector = {r["key"]: np.array(r["vector"]) for r in rows}
    assert "rare" not in vector and len(vector) == 24 + 8
    unit = {k: v / np.linalg.norm(v) for k, v in vector.items()}
    for a in "abcd":
        near = max((k for k in unit if k.startswith("syn") and k != f"syn{a}0"), key=lambda k: unit[k] @ unit[f"syn{a}0"])
        assert near == f"syn{a}1"
    again = cbow.cbow(frame.repartition(5), size=20, epochs=15, parts=4, rate=0.05, frequent=1.0).collect()
    assert {r["key"]: r["vector"] for r in again} == {r["key"]: r["vector"] for r in rows}
    assert cbow.cbow(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        cbow.cbow(frame, most_words=3)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_runs_are_stored_by_method_and_resumed(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from senseloom.plans import corpus, sql

    c = corpus.Corpus(spark, str(DATA))
    folder = corpus.runs_of(c, ["louvain", "components"], [5, 20], f"{tmp_path}/senses")
    assert runs.done(spark, folder) == {(m, n) for m in ("louvain", "components") for n in (5, 20)}
    files = {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}
    corpus.runs_of(c, ["louvain", "components"], [5, 20], folder)
    assert {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")} == files  # nothing was written anew
    # The same inventory, assignment and links in SQL, from the stored communities.
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    for n in (5, 20):
        duck.sql(f"CREATE OR REPLACE VIEW stored AS SELECT lemma, token, community FROM '{folder}/communities/method=louvain/n_reps={n}/*.parquet'")
        after = sql.COMMUNITIES.split("\npop AS")[1]
        parts = (sql.TOKENS, sql.FILLERS, sql.INSTANCES, sql.cleaned("subs", "inst", n, True), "\ncomm AS (SELECT * FROM stored)", "\npop AS" + after, sql.senses(corpus.MIN_SECOND), sql.ASSIGNED, sql.LINKS)
        for table, columns, name in (("inventory", "lemma, sense_id, rank, token, cnt", "sense"), ("assigned", "lemma, file_id, pos, sense_id, shared, total", "assigned"), ("links", "sense, neighbour, shared, total, rank", "link")):
            expected = duck.sql(sql.statement(f"SELECT {columns} FROM {name}", *parts)).fetchall()
            found = runs.read(spark, folder, table).where((F.col("method") == "louvain") & (F.col("n_reps") == n)).select(*columns.split(", ")).collect()
            assert sorted(map(tuple, found)) == sorted(expected) and expected


def plan(frame):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        frame.explain("formatted")
    return out.getvalue()


def test_stored_index_reads_one_bucket_and_joins_without_a_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(f"l{i % 40}", i % 7, i) for i in range(2000)], "lemma string, file_id long, pos long")
    index.write_index(rows, "index_of_a_test", folder=f"file://{tmp_path}")
    table = index.stored_index(spark, "index_of_a_test")
    try:
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else a plan without a join does not say how many buckets it reads
        assert "SelectedBucketsCount: 1 out of 64" in plan(table.where("lemma = 'l3'"))
        assert "Exchange hashpartitioning(lemma" not in plan(table.join(table.groupBy("lemma").count().hint("merge"), "lemma"))
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
        index.write_index(spark.createDataFrame([("l3", 5, 1), ("new", 8, 2)], rows.schema), "index_of_a_test", batch=1)
        expected = [tuple(r) for r in rows.collect() if r["file_id"] != 5] + [("l3", 5, 1), ("new", 8, 2)]
        assert sorted(map(tuple, index.stored_index(spark, "index_of_a_test").collect())) == sorted(expected)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql("DROP TABLE index_of_a_test")


def test_scores_are_rounded_like_their_binary_values(spark):
    values = [i / n for n in range(1, 111) for i in range(n + 1)]
    found = spark.createDataFrame([(v,) for v in values], "x double").select("x", two_decimals(F.col("x")).alias("t")).collect()
    assert all(r["t"] == f"{r['x']:.2f}" for r in found)
