"""Instances, keys, contexts, fallbacks and stored vectors on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from senseloom.operators import evaluation, instances, senses, vectors


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_instances(spark):
    targets = spark.createDataFrame([("Play", "play"), ("playgrounds", "playground"), ("is n't", "be"), ("", "be")], "target string, lemma string")
    assert rows(targets.select(instances.single_piece(F.col("target"), F.col("lemma")).alias("p")), "p") == [("be",), ("be",), ("play",), ("playgrou",)]
    tokens = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["give", "it", "up", "give"])], "file_id long, doc_id long, pos long, token string")
    asked = spark.createDataFrame([("give.v.1", 1, "gave up", 1), ("it.n.2", 1, "It", 0)], "inst_id string, doc_id long, target string, which long")
    assert rows(instances.index_by_occurrence(tokens, asked), "inst_id", "pos") == [("give.v.1", 3), ("it.n.2", 1)]
    words = spark.createDataFrame([("one",), ("two",)], "word string")
    assert instances.require_single_pieces(words) is words
    with pytest.raises(ValueError, match="extraordinary"):
        instances.require_single_pieces(words.union(spark.createDataFrame([("extraordinary",)], "word string")))
    one, other = spark.createDataFrame([("a", 1), ("b", 2)], "inst_id string, x int"), spark.createDataFrame([("b", 3, "y"), ("c", 4, "z")], "inst_id string, x int, y string")
    assert rows(instances.merge(one, other).fillna("-"), "inst_id", "x", "y") == [("a", 1, "-"), ("b", 2, "-"), ("c", 4, "z")]
    places = spark.createDataFrame([("a", 10), ("a", 10), ("b", 11)], "inst_id string, file_id long")
    assert rows(instances.with_documents(one, places), "inst_id", "file_id") == [("a", 10), ("b", 11)]
    with pytest.raises(Exception, match="several documents"):
        instances.with_documents(one, places.union(spark.createDataFrame([("b", 12)], "inst_id string, file_id long"))).collect()
    pairs = spark.createDataFrame([(["a", "b", "a"], ["c", None]), (None, ["b"])], "x array<string>, y array<string>")
    assert rows(instances.distinct_words(pairs, "x", "y"), "word") == [("a",), ("b",), ("c",)]


def test_keys_and_contexts(spark):
    keys = spark.createDataFrame([(k,) for k in ("bank", "bank_1", "bank_3", "bank_10", "run", "runs_0", "RUN", "Run_2", "lone")], "key string")
    words = spark.createDataFrame([("bank",), ("runs",), ("lone",), ("gone",)], "word string")
    lemmas = spark.createDataFrame([("runs", "run"), ("bank", "bank"), ("lone", "bank")], "word string, lemma string")
    found = evaluation.candidate_keys(words, keys, lemmas)
    assert rows(found, "word", "nth", "key") == [("bank", 0, "bank_1"), ("bank", 1, "bank_3"), ("lone", 0, "lone"), ("lone", 1, "bank_1"), ("lone", 2, "bank_3"), ("runs", 0, "runs_0"), ("runs", 1, "run")]
    assert rows(evaluation.candidate_keys(words, keys), "word", "key") == [("bank", "bank_1"), ("bank", "bank_3"), ("lone", "lone"), ("runs", "runs_0")]
    assert rows(evaluation.variant_keys(spark.createDataFrame([("run",), ("BANK",)], "word string"), keys), "word", "key") == [("run", "RUN"), ("run", "Run_2"), ("run", "run")]
    one = spark.range(1)
    of = lambda column: one.select(column.alias("x")).first()["x"]
    words = F.array(*(F.lit(w) for w in ["the", "old", "bank", ",", "by", "the", "river", "bank", "?!"]))
    assert of(evaluation.context_words(words, F.lit(2))) == ["old", "river", "bank", "?!"]
    assert of(evaluation.ordered_union(F.array(F.lit("b"), F.lit("b_2")), F.array(F.lit("a_1"), F.lit("b_2")))) == ["b_2", "a_1"]
    assert of(evaluation.ordered_union(F.array(F.lit("b")), F.array(F.lit("a"), F.lit("b")))) == ["b", "a"]


def test_vectors_are_found_by_key(spark, tmp_path):
    frame = spark.createDataFrame([(f"k{i:03}", [float(i), 0.0]) for i in range(100)], "key string, vector array<double>")
    vectors.save_vectors(frame, f"{tmp_path}/v", 4)
    assert rows(vectors.load_vectors(spark, f"{tmp_path}/v"), "key", "vector") == rows(frame, "key", "vector")
    assert rows(vectors.load_vectors(spark, f"{tmp_path}/v", ["k007", "k042"]), "key") == [("k007",), ("k042",)]
    with pytest.raises(KeyError):
        vectors.load_vectors(spark, f"{tmp_path}/v", ["k007", "none"])
    held = spark.createDataFrame([("a", [3.0, 4.0]), ("zero", [0.0, 0.0]), ("UNK", [2.0, 0.0])], "key string, vector array<double>")
    asked = spark.createDataFrame([("a",), ("b",), ("zero",)], "word string")
    assert rows(evaluation.with_fallback(asked, held), "word", "vector", "known") == [("a", [0.6, 0.8], True), ("b", [2.0, 0.0], False), ("zero", [0.0, 0.0], True)]
    assert [r["vector"] for r in evaluation.with_fallback(asked.where("word = 'b'"), held.where("key = 'a'")).collect()] == [None]


def test_examples(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, "aa xx"), (3, None)], "doc_id long, text string")
    assigned = spark.createDataFrame([("cc", 0, 1, 2), ("aa", 1, 2, 0), ("aa", 1, 1, 0), ("aa", 1, 1, 3)], "lemma string, sense_id long, file_id long, pos long")
    found = rows(senses.examples(assigned, docs, 2, 1), "lemma", "sense_id", "nth", "file_id", "pos", "example")
    assert found == [("aa", 1, 1, 1, 0, "aa bb"), ("aa", 1, 2, 1, 3, "cc dd ee"), ("cc", 0, 1, 1, 2, "bb cc dd")]
