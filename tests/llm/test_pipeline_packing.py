import pytest

import corpus_pipeline


def test_pipeline_returns_token_ids(spark):
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    text = "some words to be packed"
    row = corpus_pipeline.pack_tokens(spark, spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string"), "").first()
    ids = tokenizers.Tokenizer.from_file(files.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids
    assert row["ids"] == [*ids, 2] and row["length"] == len(row["ids"])
