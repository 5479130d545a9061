"""Pieces are cut in one pass of a text, and neighbours are laid beside them."""

from pyspark.sql import functions as F

from senseloom.operators import text

TEXTS = [None, "", "...", "a", "#a##b c#d", "naïveté-naïvetés’ abcdefgh abcdefghi abcdefghijklmnopq", "Straßenbahnhaltestelle ÀÉÎ", "x😀y abcdefghi😀jklmnopqr 𝒜𝒷𝒸𝒹𝒺𝒻𝒼𝒽𝒾𝒿𝓀", "{ab |cd ~ef `gh  ij’kl", "ééééééééééé ñ", "日本語日本語日本語日本 語", "İstanbul ǅungla", "a\nb\r\tc12d3"]


def test_raw_pieces_are_the_pieces(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = []
    for r in docs.select("doc_id", text.pieces(F.col("text")).alias("p")).collect():
        p = r["p"] or []
        want += [(r["doc_id"], i, x, x.startswith("##"), p[i - 1] if i else None, p[i + 1] if i + 1 < len(p) else None) for i, x in enumerate(p)]
    assert len(want) > 40
    assert [tuple(r) for r in text.tokens(docs).orderBy("file_id", "pos").collect()] == want
    counted = {r["token"]: r["n"] for r in text.counted_tokens(docs).collect()}
    assert counted == {x: sum(w[2] == x for w in want) for x in {w[2] for w in want}}
    assert [r["p"] for r in docs.where("doc_id = 4").select(text.pieces(F.col("text")).alias("p")).collect()] == [["a", "b", "c", "d"]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_cut_by_one_expression_without_work_per_element(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    held = plan(text.tokens(docs))
    assert "regexp_replace" not in held and "transform(" not in held and "arrays_zip" in held
