"""Occurrences are dealt by context once: graphs, instances and senses read one bucketed table, and substitutes are found once for each context and token."""

import random

from pyspark.sql import functions as F

from senseloom.operators import index, substitutes
from senseloom.plans import corpus


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def occurrences(spark):
    draw = random.Random(7)
    rows = [(w.rstrip("s"), f, p, w, draw.choice("xyz"), draw.choice([*"uv", None]), p == 0) for f in range(60) for p, w in enumerate(draw.choices(["a", "cats", "cat", "dog", "bird", "birds", "fish"], k=5))]
    return spark.createDataFrame(rows, "lemma string, file_id long, pos long, token string, prev string, next string, first boolean")


def test_edges_of_contexts_move_only_rows_of_a_lemma(spark):
    assert exchanges(corpus.Corpus(spark, "/root/testdata/sf0.001").edges) == 1


def test_by_token_equals_nearest(spark):
    held = index.mark_sampled(occurrences(spark), 4)
    contexts, fillers = substitutes.by_context(held, 3), substitutes.context_fillers(held)
    for n, drop_query in ((1, True), (2, False), (5, True)):
        want = substitutes.nearest(held.where("sampled"), fillers, n, drop_query).select("lemma", "file_id", "pos", "reps", "probs")
        got = substitutes.by_token(contexts, n, drop_query).select("lemma", F.explode("found").alias("o"), "reps", "probs").select("lemma", "o.file_id", "o.pos", "reps", "probs")
        assert want.count() and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        times = substitutes.by_token(contexts, n, drop_query, sampled=False)
        assert "times" not in times.columns and times.count() >= got.count() / 4


def test_the_edge_of_a_sample_is_found_without_moving_it(spark):
    rows = [("a", f, 0, "a", "x", "y", True) for f in range(400)] + [("b", f, 1, "b", "x", "y", f != 3) for f in range(5)]
    frame = spark.createDataFrame(rows, "lemma string, file_id long, pos long, token string, prev string, next string, first boolean")
    marked = index.mark_sampled(frame, 10)
    assert exchanges(marked) == 0
    assert {r["lemma"]: r["count"] for r in marked.where("sampled").groupBy("lemma").count().collect()} == {"a": 10, "b": 4}
    assert index.mark_sampled(frame, 0).where("sampled").count() == 0 and index.mark_sampled(frame, -1).where("sampled").count() == 404


def test_ranked_rows_equal_substitutes(spark):
    held = index.mark_sampled(occurrences(spark), 4)
    many = spark.createDataFrame([(f"w{t % 12}", f, t, f"w{t % 12}", "p", "q", True) for f in range(3) for t in range(0, 12, f + 1)], held.drop("sampled").schema)
    held = held.unionByName(many.withColumn("sampled", F.lit(True)))
    contexts = substitutes.by_context(held, 3)
    for kept in (2, 11, 100):
        found = substitutes.substitutes(held.where("sampled"), substitutes.context_fillers(held, kept + 1), kept)
        total = F.aggregate("reps", F.lit(0).cast("long"), lambda s, x: s + x["cnt"]).alias("total")
        want = found.select("lemma", "file_id", "pos", total, F.posexplode("reps").alias("rank", "x")).select("lemma", "file_id", "pos", (F.col("rank") + 1).cast("long").alias("rank"), "x.token", (F.col("x.cnt") / F.col("total")).alias("prob"))
        got = substitutes.ranked_rows(contexts, kept)
        assert want.count() and got.schema.simpleString() == want.schema.simpleString() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert exchanges(got) == 0
