"""The sample's subwords are held whole on the driver while the classifier learns, so they are kept narrow."""

import numpy as np

from senseloom.llm import toxicity


def test_subwords_are_narrow():
    texts = ["you are a nice person, really", "", "some other words 12"] * 20
    held = toxicity.subwords(texts, 16, (3, 4, 5, 6), 2)
    assert held.bucket.itemsize + held.word.itemsize <= 6
    wide = toxicity.subwords(texts, 20, (3, 4, 5, 6), 2)
    assert wide.bucket.max() >= 1 << 16 and np.array_equal(wide.bucket >> 4, held.bucket) and np.array_equal(wide.word, held.word)
    assert held.word.max() + 1 == 20 * 10 and len(held.bucket) == len(held.word)
