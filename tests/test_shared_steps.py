"""The index, samples and fillers move their rows as little as they can: no shuffle of occurrences by token, a sample cut before it is shuffled, one dealing by context."""

import hashlib

from pyspark.sql import functions as F

from senseloom.operators import index, substitutes, text


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_sample_is_cut_before_it_is_shuffled(spark):
    rows = [("a", f, p, "a", "x", "y") for f in range(300) for p in (2, 5)] + [("b", f, 1, "b", "x", "y") for f in range(7)]
    frame = spark.createDataFrame(rows, "lemma string, file_id long, pos long, token string, prev string, next string")
    want = sorted(range(300), key=lambda f: (hashlib.md5(f"111:{f}".encode()).hexdigest(), f))[:10]
    for source in (frame, index.mark_first(frame)):
        got = index.instances(source, 10)
        assert sorted((r["lemma"], r["file_id"], r["pos"]) for r in got.collect()) == sorted([("a", f, 2) for f in want] + [("b", f, 1) for f in range(7)])
    digest = F.md5(F.concat(F.lit("111:"), F.col("file_id").cast("string")))
    left = index.promising(frame.where("pos < 5"), digest, 10).groupBy("lemma").count().collect()
    assert {r["lemma"]: r["count"] for r in left}["b"] == 7 and 10 <= {r["lemma"]: r["count"] for r in left}["a"] < 20


def test_occurrences_stay_with_their_file(spark):
    docs = spark.createDataFrame([(i, "the clowns walked past a clown and walk on") for i in range(20)], "file_id long, text string").repartition(4, "file_id")
    vocab = spark.createDataFrame([(t, "clown" if t == "clowns" else t) for t in "the clowns walked past a clown and walk on".split()], "token string, lemma string")
    found = index.mark_first(index.inverted_index(text.tokens(docs, "file_id"), vocab))
    assert exchanges(found) == 1  # the dealing of the documents
    assert sorted((r["pos"], r["lemma"], r["first"]) for r in found.where("file_id = 3 AND lemma = 'clown'").collect()) == [(1, "clown", True), (5, "clown", False)]


def test_contexts_are_dealt_once(spark):
    frame = spark.createDataFrame([("a", "a", "x", "y"), ("b", "b", "x", "y"), ("b", "b", "x", "y")], "lemma string, token string, prev string, next string")
    fillers = substitutes.context_fillers(frame)
    assert exchanges(fillers) == 1 and exchanges(substitutes.leading(fillers, 5)) <= 2
    assert [tuple(r) for r in fillers.select("token", "cnt", "rank").orderBy("rank").collect()] == [("b", 2, 1), ("a", 1, 2)]
