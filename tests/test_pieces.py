"""Pieces are cut in passes of the whole text; what a word's letters are and where marks stand does not change."""

import random
import re

from pyspark.sql import functions as F

from senseloom.operators import text


def test_pieces_equal_words_cut_one_by_one(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("abÄßé#Ωж𝒳0 -_.\n\u0001́İ", k=draw.randrange(60))) for _ in range(300)] + ["", "##ab", "abcdefgh##ij", "abcdefghi#", "#", "a" * 33, "𝒳" * 17 + "#" + "x" * 8]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = frame.select("text", F.lower("text").alias("low"), text.pieces(F.col("text")).alias("p"), text.pieces(F.col("text"), r"(?:\p{L}+)").alias("slow")).collect()
    for r in got:
        words = re.findall(r"[^\W\d_]+", r["low"] or "")
        want = [("##" if i else "") + w[i : i + 8] for w in words for i in range(0, len(w), 8)]
        assert r["p"] == r["slow"] == (None if r["text"] is None else want)
    plan = frame.select(text.pieces(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
