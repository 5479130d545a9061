"""A look-up of some lemmas reads the documents once, and finds what the whole index has."""

from senseloom.operators import index, text


def test_look_up_in_equals_the_index(spark):
    words = "cats cat casting cast casts ing sing sings news new red clowns walking walked passeds passed pass sheds shed"
    docs = spark.createDataFrame([(1, words), (2, "the cats sing, casting news"), (3, "clowns clownsing abcdefghs abcdefgh"), (4, None)], "doc_id long, text string")
    tokens = text.tokens(docs)
    whole = index.inverted_index(tokens, text.vocabulary(tokens))
    for lemmas in (["cat", "cast"], ["clowns"], ["walking", "new"], ["passed", "sing", "red", "shed"]):
        found = sorted(tuple(r) for r in whole.where(whole.lemma.isin(*lemmas)).collect())
        present = sorted({r[0] for r in found})
        assert present and sorted(tuple(r) for r in index.look_up_in(tokens, present).collect()) == found


def test_look_up_in_tokenises_once(spark):
    tokens = text.tokens(spark.createDataFrame([(1, "a cat")], "doc_id long, text string"))
    assert "regexp_extract_all" not in index.look_up_in(tokens, ["cat"])._jdf.queryExecution().optimizedPlan().toString()
