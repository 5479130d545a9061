"""Exact nearest senses without all pairs, cleaned substitutes by context, and the binned interval join, each against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from senseloom.operators import link, substitutes, text


def plain_closest(sets, kept):
    """Every pair of senses, best score first, then the last name."""
    out = set()
    for a, x in sets.items():
        scored = sorted(((len(x & y) / len(x | y), b) for b, y in sets.items() if b != a), reverse=True)[:kept]
        out |= {(a, b, len(x & sets[b]), len(x | sets[b]), score, i + 1) for i, (score, b) in enumerate(scored)}
    return out


@pytest.mark.parametrize("kind", ["mixed", "copies", "few", "frequent"])
def test_closest_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(len(kind))
    names = [f"t{i}" for i in range(60)]
    weight = 1 / np.arange(1, 61)
    sets = {}
    for i in range({"few": 5}.get(kind, 150)):
        size = int(rng.integers(1, 9))
        chosen = rng.choice(names, size, replace=False, p=weight / weight.sum())
        if kind == "copies" and i % 3 == 0:
            chosen = ["t1", "t4", "t5", "t9"]
        if kind == "frequent":
            chosen = [*chosen, "the", "of"]
        sets[f"w{i // 2}_{i % 2}"] = frozenset(map(str, chosen)) | ({f"only{i}"} if i % 11 == 0 else set())
    rows = [(k.split("_")[0], int(k.split("_")[1]), sorted(v)) for k, v in sets.items()]
    frame = spark.createDataFrame(rows, "lemma string, sense_id long, tokens array<string>").repartition(3)
    for kept in (11, 3):
        assert {tuple(r) for r in link.closest(frame, kept).collect()} == plain_closest(sets, kept)
    assert link.closest(frame.where("false")).count() == 0


def test_a_frequent_token_makes_few_pairs(spark):
    rng = np.random.default_rng(1)
    sets = sorted({(0, *sorted(map(int, rng.choice(np.arange(1, 900), 5, replace=False)))) for _ in range(600)})
    # Rare to frequent: the token that all have comes last.
    frame = spark.createDataFrame([(i, [*s[1:], 1000]) for i, s in enumerate(sets)], "of long, set array<long>")
    met = link.candidates_by_heads(frame, 11).count() + link.candidates_by_prefix(frame, frame.select("of", F.lit(0.1).alias("floor")), 6).count()
    assert met < len(sets) ** 2 / 8


def test_sets_are_broadcast_in_slices_and_equal_scores_prune(spark, monkeypatch):
    rng = np.random.default_rng(6)
    weight = 1 / np.arange(1, 41)
    sets = sorted({tuple(sorted(map(int, rng.choice(40, 7, replace=False, p=weight / weight.sum())), reverse=True)) for _ in range(220)})
    frame = spark.createDataFrame([(i, [100 - x for x in s]) for i, s in enumerate(sets)], "of long, set array<long>")
    want = {}
    for i, x in enumerate(sets):
        scored = sorted(((len({*x} & {*y}) / len({*x} | {*y}), j) for j, y in enumerate(sets) if j != i and {*x} & {*y}), reverse=True)[:3]
        want |= {(i, j): score for score, j in scored}
    slices, by_prefix = [], link.candidates_by_prefix
    monkeypatch.setattr(link, "candidates_by_prefix", lambda *a, others, **k: slices.append(others.count()) or by_prefix(*a, others=others, **k))
    found = {(r["of"], r["other"]): r["score"] for r in link.closest_sets(frame, 3, 60).collect()}
    assert found == want and len(slices) == -(-len(sets) // 60) and sum(slices) == len(sets) and max(slices) < 100
    floors = spark.createDataFrame([(i, score, j) for (i, j), score in want.items() if score == min(s for (k, _), s in want.items() if k == i)], "of long, floor double, last long").groupBy("of").agg(F.max("floor").alias("floor"), F.min("last").alias("last"))
    assert by_prefix(frame, floors, 7).count() < by_prefix(frame, floors.drop("last"), 7).count()


def fillers_of(spark, rng):
    """Contexts with fillers of few lemmas, so that lemmas repeat and own tokens lead them."""
    rows = []
    for c in range(12):
        n = int(rng.choice([2, 5, 30, 101]))
        tokens = rng.choice(400, n, replace=False)
        rows += [(f"p{c}", "n", f"f{t}", f"l{t % int(rng.choice([3, 40, 400]))}", int(200 - i), i + 1) for i, t in enumerate(tokens)]
    lemma = {r[2]: r[3] for r in reversed(rows)}
    return [(p, n, t, lemma[t], cnt, rank) for p, n, t, _, cnt, rank in rows], lemma


@pytest.mark.parametrize("drop", [True, False])
def test_cleaning_by_context_equals_cleaning_by_occurrence(spark, drop):
    rng = np.random.default_rng(4)
    rows, lemma = fillers_of(spark, rng)
    fillers = spark.createDataFrame(rows, "prev string, next string, token string, lemma string, cnt long, rank long")
    seen = [(lemma[t], i, i, t, p, n) for i, (p, n, t, *_) in enumerate(rows)]
    seen += [("other", 9000 + c, c, "beyond", f"p{c}", "n") for c in range(12)] + [("l1", 9100 + c, c, "beyond too", f"p{c}", "n") for c in range(12)]
    occurrences = spark.createDataFrame(seen, "lemma string, file_id long, pos long, token string, prev string, next string")
    columns = ("lemma", "file_id", "pos", "reps", "probs")
    for n in (1, 3, 5, 20, 100):
        plain = substitutes.clean(substitutes.substitutes(occurrences, fillers), n, drop).select(*columns)
        assert sorted(substitutes.nearest(occurrences, fillers, n, drop).select(*columns).collect()) == sorted(plain.collect())


def test_interval_join_across_bins(spark):
    rng = np.random.default_rng(9)
    lines = [" ".join("abcdefghijkl"[: int(rng.integers(1, 12))] for _ in range(rng.integers(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None), (4, "İstanbul ﬁn\n\n\nx" + " word" * 700)], "doc_id long, text string")
    tokens, spans = text.tokens(docs).select("file_id", "pos"), text.paragraphs(docs)
    starts = {(r["file_id"], r["paragraph"]): (r["start"], r["end"]) for r in spans.collect()}
    assert max(e for (f, _), (_, e) in starts.items() if f == 4) == tokens.where("file_id = 4").count()
    expected = sorted((f, p, par, p - s) for f, p in (tuple(r) for r in tokens.collect()) for (g, par), (s, e) in starts.items() if f == g and s <= p < e)
    assert len(expected) == tokens.count()
    for width in (1, 7, 256, 1 << 20):
        assert sorted(tuple(r) for r in text.locate(tokens, spans, width).collect()) == expected
