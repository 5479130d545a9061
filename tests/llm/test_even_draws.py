"""The mix meets its targets however long documents are; scores do not hang on neighbouring rows; token ids are the tokenizer's."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from senseloom.llm import mixing, packing, quality
from senseloom.llm.queries import tokenizer_path


def test_taken_words_miss_a_target_by_half_a_document(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * int(10 ** rng.uniform(0, 3.5))), f"s{i % 5}" if i % 11 else None) for i in range(400)]
    planned = mixing.plan_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in planned.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("longest")).collect():
        assert abs(r["taken"] - r["target"]) <= r["longest"] / 2 + 1e-6


def test_the_cut_by_hand(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), "ab"[i % 3 == 0]) for i in range(300)]
    drawn = mixing.plan_copies(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", mixing.draw(1, F.col("doc_id"), F.col("text")))).collect()
    for source in "ab":
        mine = sorted((r for r in drawn if r["source"] == source), key=lambda r: r["key"])
        before, rate = 0, mine[0]["rate"]
        for r in mine:
            wanted = (rate - int(rate)) * r["source_size"]
            assert r["copies"] == int(rate) + (wanted > 0 and before + r["size"] / 2 <= wanted)
            before += r["size"]


def random_texts(n, seed):
    rng = random.Random(seed)

    def word():
        kind = rng.random()
        if kind < 0.5:
            return "".join(chr(rng.randrange(1, 0x250)) for _ in range(rng.randrange(1, 9)))
        if kind < 0.7:
            return "".join(rng.choice("ƏƆƐİıȺȾſßÀé'’s.,-0¹²½ª") for _ in range(rng.randrange(1, 7)))
        if kind < 0.8:
            return "".join(chr(c) for c in (rng.randrange(1, 0x110000) for _ in range(4)) if not 0xD800 <= c < 0xE000)
        return "".join(rng.choice("abcDEF'stlmdre.0129-_<|>") for _ in range(rng.randrange(1, 10)))

    return ["".join(word() + rng.choice(["", " ", "\n", "\t", "  ", "\x0b", "\x1f"]) for _ in range(rng.randrange(0, 9))) for _ in range(n)]


def test_ids_are_the_tokenizers():
    tokenizer = packing.WordTokenizer(tokenizer_path())
    texts = [*random_texts(3000, 5), "Əliyev, Bakı."]
    ids, sizes = tokenizer.encode(pa.array(texts, pa.large_string()))
    for text, found in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert found.tolist() == tokenizer.whole.encode(text, add_special_tokens=False).ids


def test_votes_are_those_of_plain_cosines():
    texts = [x for x in random_texts(400, 6) if x.strip()]
    labels = [float(len(x) % 3 == 0) for x in texts]
    model = quality.train(texts[:200], labels[:200], dim=12, neighbours=7)
    found = model.scores(texts[200:])
    for text, score in zip(texts[200:], found, strict=True):
        latent = quality.features([text])[0] @ model.project
        latent = latent / np.linalg.norm(latent)
        near = np.array([(latent * v).sum() / (np.linalg.norm(latent) * np.linalg.norm(v)) for v in model.vectors])
        best = np.argsort(-near)[:7]
        weight = np.maximum(0, near[best]) ** 8
        assert abs(score - (weight * model.labels[best]).sum() / weight.sum()) < 1e-3


def test_a_score_hangs_on_its_text_alone():
    texts = [*random_texts(150, 7), "", " ", "\n", "a", "x\n\n", "\n\nx", "AbC " * 50]
    model = quality.train(texts[:60], [float(i % 2) for i in range(60)], dim=12)
    alone = [model.scores([x])[0] for x in texts]
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(texts))
        for a in range(0, len(order), 41):
            some = order[a : a + 41]
            assert model.scores([texts[i] for i in some]).tolist() == [alone[i] for i in some]
