import re

import numpy as np
import pytest
import xxhash

from senseloom.llm import nearcopies, simhash
from senseloom.llm.components import components


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(keys, near):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b", "A b C", "a b c d a b c d", "É é x É", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize(("block", "hot"), [(20_000, 1_000_000), (30, 1_000_000), (30, 5)])
def test_links_find_all_pairs(spark, block, hot):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    made = [x ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for x in base for i, j in rng.integers(0, 64, (12, 2))]
    keys = sorted({int(x) for x in np.array([*base, *made], np.uint64).view(np.int64)})
    frame = spark.createDataFrame([(k,) for k in keys], "fp long")
    links = simhash.fingerprint_links(frame, 2, block, hot)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    mask = (1 << 64) - 1
    expected = brute_components(keys, lambda a, b: ((a ^ b) & mask).bit_count() <= 2)
    assert {k: found.get(k, k) for k in keys} == expected
    assert len(set(expected.values())) < len(keys)


def test_near_copies_with_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (7, long_text, "d"), (5, long_text + " end", "e"), (9, long_text, "f"), (9, long_text, "f"), (None, "alone in the dark", "g"), (11, "quite another text here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_copies(docs).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (7, 5), (5, 5), (9, 5), (None, None), (11, 11)}
    assert all(int(r["fingerprint"], 16) == 0 for r in found if r["doc_id"] in (1, 2, 3))
    kept = nearcopies.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 5, 11]


def test_documents_without_an_id_stay(spark):
    rows = [(None, "the first of them says this", 1), (None, "and another one says something else", 2), (None, "and another one says something else", 2), (4, "an id that comes twice", 3), (4, "with quite different words in it", 4), (None, None, 5), (8, " ", 6)]
    kept = nearcopies.keep_first(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()
    assert sorted(r["extra"] for r in kept) == [1, 2, 3, 4, 6]


def test_empty_table(spark):
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    odd = [(5000, 5000), (6000, 6001), (6001, 6000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + hub + odd, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(200)} | {6000: 6000, 6001: 6000}
