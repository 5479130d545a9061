"""Votes, labels, senses and item sets deal rows by lemma once; rows that stand for several instances count as often."""

from collections import Counter
from itertools import combinations

import pytest

from senseloom.operators import graph, itemsets, senses


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange")


@pytest.fixture
def cleaned(spark):
    lists = [["a", "b", "c"], ["a", "b"], ["d", "e"], ["d", "e", "a"], ["b", "c"], ["d", "e"], ["a", "b", "c"]]
    return spark.createDataFrame([(lemma, f, f % 3, r) for lemma in ("x", "y") for f, r in enumerate(lists) if lemma == "x" or f], "lemma string, file_id long, pos long, reps array<string>")


@pytest.fixture
def communities(spark):
    return spark.createDataFrame([(lemma, t, c) for lemma in ("x", "y") for t, c in (("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1), ("f", 1))], "lemma string, token string, community long")


def test_labels_move_rows_once(spark, cleaned, communities):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        labels = senses.hard_labels(senses.argmax(senses.votes(cleaned, communities, 3)))
        assert exchanges(labels) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r["file_id"], r["label"]) for r in labels.where("lemma = 'x'").collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 0), (5, 1), (6, 0)]


def test_rows_that_stand_for_several_instances(spark, cleaned, communities):
    held = Counter((r["lemma"], tuple(r["reps"])) for r in cleaned.collect())
    times = spark.createDataFrame([(lemma, list(r), n) for (lemma, r), n in held.items()], "lemma string, reps array<string>, times long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(senses.inventory(cleaned, communities, 1, 2))
    assert want[:4] == [("x", 0, 1, "a", 4), ("x", 0, 2, "b", 4), ("x", 1, 1, "d", 3), ("x", 1, 2, "e", 3)]
    assert rows(senses.inventory(times, communities, 1, 2)) == want
    assert rows(graph.edges(times, 3)) == rows(graph.edges(cleaned))
    found = Counter((r["lemma"], " ".join(s)) for r in cleaned.collect() for n in (1, 2, 3) for s in combinations(sorted(r["reps"]), n))
    sets = [(lemma, s, s.count(" ") + 1, n) for (lemma, s), n in found.items() if n >= 2]
    assert rows(itemsets.apriori(times, 2, 3)) == rows(itemsets.apriori(cleaned, 2)) == sorted(sets)


def test_an_inventory_deals_its_rows_once(spark, cleaned, communities):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = senses.inventory(cleaned, communities, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") == 1


def test_a_lemma_does_not_travel_with_occurrences(spark):
    index = spark.createDataFrame([("cat", f, p, t, "x", n) for f, p, t, n in ((1, 0, "cats", "y"), (1, 5, "cat", "y"), (2, 3, "cats", None))], "lemma string, file_id long, pos long, token string, prev string, next string")
    near = spark.createDataFrame([("x", "y", t, "cat", ["dog", "fish"]) for t in ("cat", "cats")], "prev string, next string, token string, lemma string, reps array<string>")
    inventory = spark.createDataFrame([("cat", 0, 1, "dog", 3), ("cat", 1, 1, "bird", 2)], "lemma string, sense_id long, rank long, token string, cnt long")
    found = senses.assign_by_token(index, near, inventory)
    assert sorted((r["lemma"], r["file_id"], r["pos"], r["sense_id"], r["score"]) for r in found.collect()) == [("cat", 1, 0, 0, 0.5), ("cat", 1, 5, 0, 0.5)]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "prev" in line]
    assert joins and not any("lemma" in line for line in joins)
