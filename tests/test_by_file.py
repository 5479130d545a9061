"""What groups the index by file moves none of its rows: texts are dealt by file before they become rows."""

from pyspark.sql import functions as F

from senseloom.operators import index, text
from senseloom.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_and_first_occurrences_move_no_rows_of_the_index(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = plan(catalogue.QUERIES["index_positions"](spark, "/root/testdata/sf0.001"))
        docs = spark.createDataFrame([(1, "a cat and a cat"), (2, "no cat")], "file_id long, text string").repartition(3, "file_id")
        found = index.first_occurrences(text.tokens(docs, "file_id").select(F.col("token").alias("lemma"), "file_id", "pos"))
        assert plan(found).count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "hashpartitioning(lemma" not in held
    assert sorted(map(tuple, found.where("lemma = 'cat'").collect())) == [("cat", 1, 1), ("cat", 2, 1)]
