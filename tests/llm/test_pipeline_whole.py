"""The whole pipeline against a plain one, over odd rows whose extra columns have names that the operators use inside."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from senseloom.llm import secrets, toxicity

NAMES = """_source cut rate copies _copy _kept_rate row _row of draw part size source_size target score predicted c0 C1 text_hash node root first _id _of unit block u v key near keys
length start ids ids_crc32 doc_tokens sequence_id offset _bucket _ordinal bucket spans n_assign base_sha256""".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made_rows():
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("bcdfgklmnprst")) + rng.choice(list("aeiou")) for _ in range(rng.integers(1, 4)))
    rows = []
    for i in range(90):
        words = [word() for _ in range(rng.integers(12, 120))]
        if i % 3 == 0:
            words[int(rng.integers(len(words)))] = str(rng.choice(["idiot", "scumbag"]))
        rows.append([i, " ".join(words), "en", f"s{i % 4}" if i % 10 else None, 1])
    clean = [r for r in rows if r[0] % 3]
    for i, r in enumerate(clean[:12]):
        words = r[1].split()
        if len(words) > 60:
            words[30] = "changed"
        rows.append([200 + i, " ".join(words), "en", "s1", 1])
    rows += [[300, None, "en", "s0", None], [301, "", None, "s1", 0], [302, " \n ", "de", None, 3], [None, "no id but words to say here and now", "en", "s2", 1], [303, "Password = 'abcdefghijkl' kept in " + word(), "en", "s2", 1]]
    rows += [[304, " ".join(f"w{j}" for j in range(30_000)), "en", "s0", 1], [305, clean[3][1], "en", "s3", 1], [305, clean[3][1], "en", "s3", 1]]
    return [tuple(r) for r in rows], [(i, 1, int(i % 3 == 0)) for i in range(90)]


def plain_score(model, text):
    """Mean of the subwords' values over each two words, the greatest of them."""
    raw = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in (text or "").lower().encode())
    words, worst = raw.split(b" "), []
    words = [w for w in words if w]
    for a in range(0, len(words), model.stretch):
        values = []
        for w in words[a : a + model.stretch]:
            w = b" " + w + b" "
            for k in model.orders:
                for i in range(len(w) - k + 1):
                    h = 0
                    for b in w[i : i + k]:
                        h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
                    values.append(float(model.value[((h ^ (k * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - model.bits)]))
        worst.append(sum(values) / max(1, len(values)))
    return 1 / (1 + math.exp(-(max(worst, default=0.0) + model.bias)))


def plain_shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_mix(rows):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, stopped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        left, share = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9} - stopped
        if not over:
            break
        stopped |= over
    out = []
    for s in names:
        rate = min(3.0, target[s] / sizes[s]) if sizes[s] else 1.0
        draw = lambda r: hashlib.md5(f"1:{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15]
        groups, before, wanted = {}, 0, (rate - int(rate)) * sizes[s]
        for r in rows:
            if r[3] == s:
                groups.setdefault(draw(r), []).append(r)
        for _, own in sorted(groups.items()):
            n = sum(size(r[1]) for r in own)
            out += own * (int(rate) + (wanted > 0 and 2 * before + n <= 2 * wanted))
            before += n
    return out


def plain_pipeline(rows, model):
    kept = [r for r in rows if plain_score(model, r[1]) < 0.5]
    sets = [plain_shingles(r[1]) for r in kept]
    home = list(range(len(kept)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                home[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(kept):
        groups.setdefault(find(i), []).append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    masked = []
    for r in kept:
        base = secrets.base_spans(r[1]) if r[1] else []
        text = secrets.masked(r[1], sorted(base + secrets.linked_spans(r[1], base)), "[SECRET]") if r[1] else r[1]
        masked.append((r[0], text, r[2], r[3], r[4]))
    return plain_mix(masked)


def with_names(frame):
    taken = {c.lower() for c in frame.columns}
    return frame.select("*", *(F.lit(f"user's {n}").alias(n) for n in NAMES if n.lower() not in taken))


def test_pipeline_equals_the_plain_one(spark, tmp_path):
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    rows, labels = made_rows()
    docs = with_names(spark.createDataFrame(rows, COLUMNS).repartition(4))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text"), marks)
    scored = toxicity.score(docs.select("doc_id", "text"), model).collect()
    assert all(abs(r["score"] - plain_score(model, r["text"])) < 1e-6 for r in scored)

    expected = plain_pipeline(rows, model)
    assert 30 < len({r[0] for r in expected}) < len({r[0] for r in rows})
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = tokenizers.Tokenizer.from_file(files.path("word_bpe_49k.json")).encode
    wanted = Counter()
    for i, text, *_ in expected:
        ids = [*encode(text or "", add_special_tokens=False).ids, 2]
        wanted.update((i, a, tuple(ids[a : a + 4096]), len(ids)) for a in range(0, len(ids), 4096))
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"]), r["doc_tokens"]) for r in found) == wanted
    ends, windows = {}, []
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    for n in sorted((len(k[2]) for k, c in wanted.items() for _ in range(c)), reverse=True):  # best fit decreasing
        fits = [w for w in windows if w + n <= 4096]
        if fits:
            windows.remove(max(fits))
        windows.append(max(fits, default=0) + n)
    assert sorted(ends) == list(range(len(ends))) and sorted(ends.values()) == sorted(windows)


def test_stages_keep_columns_and_take_nothing(spark, tmp_path):
    rows, labels = made_rows()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = with_names(spark.createDataFrame(rows[60:], COLUMNS))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.dtypes == docs.dtypes
            assert out.select(*(F.col(f"`{c}`") == f"user's {c}" for c in docs.columns[5:])).distinct().collect() == [(True,) * (len(docs.columns) - 5)]
