import pytest

from senseloom.llm import packing


def test_remembered_words_are_bounded_and_frequent_ones_stay(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    held = packing.Recent()
    held.put("often", (1,))
    for i in range(100):
        held.put(f"rare{i}", (i,))
        assert held.get("often") == (1,) and len(held) <= 20
    assert held.get("rare0") is None


def test_a_word_of_letters_is_remembered_once():
    pytest.importorskip("tokenizers")
    files = pytest.importorskip("public_tokenizers")
    tokenizer = packing.WordTokenizer(files.path("word_bpe_49k.json"))
    want = tuple(tokenizer.whole.encode("senses", add_special_tokens=False).ids)
    assert tokenizer._word("senses") == want and len(tokenizer.words) == 1 and len(tokenizer.tokens) == 0
