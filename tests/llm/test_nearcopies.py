import numpy as np
import pytest

import corpus_pipeline
from senseloom.llm import nearcopies
from senseloom.llm.components import components


def brute(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, n):
    """A copy with ``n`` words replaced, far apart."""
    out = list(words)
    for i in np.linspace(5, len(words) - 6, n).astype(int):
        out[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_pipeline_stage_drops_edited_copies(spark):
    rng = np.random.default_rng(2)
    rows, gone = [], set()
    for g in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((g * 10, " ".join(words)))
        for i, n in enumerate((1, 3, 4, 30), 1):  # the last is too different
            rows.append((g * 10 + i, edited(rng, words, n)))
            if jaccard(brute(rows[-1][1]), brute(rows[-1 - i][1])) >= 0.8:
                gone.add(g * 10 + i)
    assert len(gone) == 120
    rows += [(1000, None), (1001, " "), (1002, "Short one"), (1003, "short ONE"), (None, "no id here"), (None, "and no id there")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _ in rows if i is not None} - gone - {1001, 1003})
    assert ids.count(None) == 2


def test_large_family_and_exact_copies(spark):
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(i, edited(rng, words, 1 + i % 3)) for i in range(150)] + [(1000 + i, " ".join(words)) for i in range(150)]
    kept = nearcopies.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_shingles_count_like_strings():
    for text in (None, "", "a", "a b c d e", "a b c d e f", "A b a b a b a b a b", "x " * 3000):
        assert len(nearcopies.shingles(text)) == len(brute(text))


@pytest.mark.parametrize("hot", [10_000, 40])
def test_a_frequent_band_loses_no_text_at_wide_bands(spark, hot):
    """Bands as wide as those of 30 million texts; with ``hot`` 40 the family shares frequent values, which are divided by the next band's."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 240)]
    texts = [" ".join(base), *(edited(rng, base, int(n)) for n in rng.integers(1, 6, 250))]
    others = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 240)) for _ in range(50)]
    width, _, most = nearcopies.layout(30_000_000)
    bands = int(np.ceil(np.log(1 - nearcopies.RECALL) / np.log(1 - (1 - np.arccos(8 / 9) / np.pi) ** width)))
    assert width == 20
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *others])], "text_hash long, text string")
    signed = nearcopies.signatures(frame, width, bands)
    links = nearcopies.candidate_links(signed, frame.count(), bands, most, hot_rows=hot)
    found = {r["node"]: r["root"] for r in components(nearcopies.exact_links(components(links), frame)).collect()}
    assert sum(found.get(i) == 0 for i in range(len(texts))) == len(texts)
    assert not any(i in found for i in range(len(texts), len(texts) + len(others)))
