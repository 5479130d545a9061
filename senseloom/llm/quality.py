"""Quality: nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of hashed counts of its form (shapes of words and of their neighbourhood, repeats of words and lines),
weighted by inverse document frequency and projected by a truncated singular value decomposition of labelled texts. Those texts' latent vectors
are broadcast (their number is bounded); every document gets exact cosine products with all of them, in blocks, and its nearest
neighbours vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from senseloom.llm.common import batched_parts, slices
from senseloom.llm.labelled import fold, labelled_sample

SAMPLE_PER_CLASS = 2_000
SAMPLE_CHARS = 20_000
SEED = 2
FEATURES = 2048

# Shape of a byte: lower-case letter or part of a non-ASCII character, upper-case letter, digit, white space, or itself.
_SHAPE = np.array([97 if b >= 128 or chr(b).islower() else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else 10 if b == 10 else 32 if b in (32, 9, 11, 12, 13) else b for b in range(256)], np.uint8)


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), 2166136261, np.uint32)
    for x in parts:
        h = (h ^ x.astype(np.uint32)) * np.uint32(0x01000193)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(9)


def _runs(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each run of non-``ends`` bytes."""
    inside = np.r_[False, ~ends, False]
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    place = np.arange(len(buffer)) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(buffer)]))
    mixed = (buffer.astype(np.uint64) + np.uint64(1)) * power[place & 63] * (place.astype(np.uint64) // np.uint64(64) * np.uint64(2) + np.uint64(1))
    total = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
    return begin, total[end] - total[begin]


def features(texts: list[str]) -> np.ndarray:
    """Dense (texts, FEATURES) matrix of damped counts, rows of length 1, in steps of 2**-16; an empty text is a row of zeros. Very long texts are counted in parts."""
    total = np.zeros((len(texts), FEATURES), np.int64)
    for of, parts in batched_parts(texts):
        np.add.at(total, np.array(of), counts(parts))
    x = np.log1p(total.astype(float))
    return in_steps(x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True)), 16)


def in_steps(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers rounded to multiples of 2**-bits: sums of their products are exact in double precision, so they do not hang on the order of the terms or the size of a batch."""
    return np.round(x * (1 << bits)) / (1 << bits)


def counts(texts: list[str]) -> np.ndarray:
    """Dense (texts, FEATURES) matrix of feature counts. A text's counts hang on that text alone: runs stop where it begins and ends."""
    raw = [x.encode() for x in texts]
    buffer = np.frombuffer(b"".join(x + b"\n" for x in raw), np.uint8)
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    begins = np.cumsum(sizes) - sizes
    shape = _SHAPE[buffer]
    # Runs of one shape; two to four of them in a row. The line feed after a text is a run of its own.
    new = np.r_[True, shape[1:] != shape[:-1]] if len(shape) else np.zeros(0, bool)
    new[begins] = new[begins + sizes - 1] = True
    change = np.flatnonzero(new)
    length = np.minimum(np.diff(np.r_[change, len(shape)]), 6).astype(np.uint32)
    kind = shape[change].astype(np.uint32) + np.uint32(256) * (length > 2)
    text_of_run = np.searchsorted(begins, change, "right") - 1
    rows, cols = [], []

    def add(salt: int, row: np.ndarray, *parts: np.ndarray) -> None:
        rows.append(row)
        cols.append(_hash(np.full(len(row), salt), *parts) % FEATURES)

    for n in (2, 3, 4):
        m = max(0, len(change) - n + 1)
        at = np.flatnonzero(text_of_run[:m] == text_of_run[n - 1 : n - 1 + m])
        add(n - 1, text_of_run[at], *(kind[at + i] for i in range(n)))
    separator = np.zeros(len(shape), bool)
    separator[begins + sizes - 1] = True
    for salt, ends in ((10, (shape == 32) | (shape == 10)), (20, (shape == 10) | separator)):
        at, key = _runs(buffer, ends)
        row = np.searchsorted(begins, at, "right") - 1
        same = np.zeros(len(at), np.uint32)
        for back in (1, 2, 3):
            if len(at) > back:
                same[back:] |= ((key[back:] == key[:-back]) & (row[back:] == row[:-back])).astype(np.uint32) << np.uint32(back)
        add(salt, row, same)
        inner = np.flatnonzero(row[1:] == row[:-1]) + 1
        add(salt + 1, row[inner], same[inner], same[inner - 1])
    found = np.bincount(np.concatenate(rows) * FEATURES + np.concatenate(cols), minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)
    found[np.array([not x.strip() for x in raw], bool)] = 0
    return found


@dataclass
class Model:
    project: np.ndarray  # (FEATURES, dim), inverse document frequencies included
    vectors: np.ndarray  # of labelled texts, length 1
    labels: np.ndarray
    prior: float
    neighbours: int

    def scores(self, texts: list[str], block: int = 512) -> np.ndarray:
        """Share of label 1 among the nearest labelled texts, weighted by cosine; the prior where nothing is similar."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        latent = unit(features(texts) @ self.project)
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(texts), block):
            near = latent[a : a + block] @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            # Steep in similarity, as cosines of texts of one kind are all high.
            weight = np.maximum(0, np.take_along_axis(near, best, 1)) ** 8
            total = weight.sum(1)
            vote = (weight * self.labels[best]).sum(1)
            out[a : a + block] = np.where(total > 1e-6, vote / np.maximum(total, 1e-6), self.prior)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in steps of 2**-22."""
    return in_steps(x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True)), 22)


def train(texts: list[str], labels: list[float], dim: int = 48, neighbours: int = 15, seed: int = SEED) -> Model:
    """Randomized truncated SVD of the weighted features of the labelled texts."""
    y = np.array(labels, float)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if not len(y):
        return Model(np.zeros((FEATURES, 1)), np.zeros((0, 1)), y, prior, neighbours)
    x = np.concatenate([features(texts[a : a + 200]) for a in range(0, len(texts), 200)])
    idf = np.log((1 + len(y)) / (1 + (x > 0).sum(0))) + 1
    weighted = (x * idf).astype(np.float32)
    rng = np.random.default_rng(seed)
    basis = weighted.T @ (weighted @ rng.normal(size=(FEATURES, min(dim + 10, FEATURES))).astype(np.float32))
    for _ in range(3):
        basis = weighted.T @ (weighted @ np.linalg.qr(basis)[0])
    q = np.linalg.qr(basis)[0]
    _, _, right = np.linalg.svd(weighted @ q, full_matrices=False)
    project = in_steps(idf[:, None] * (q @ right.T[:, :dim]), 16)
    return Model(project, unit(x @ project), y, prior, neighbours)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row; a null, empty or blank text gets the prior.

    A text's score hangs on that text and the model alone: equal texts have equal scores in any partitioning. Repeated rows are scored each. The model is
    broadcast; its size is bounded by the sample. Columns of those names are replaced; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                p = sent.value.scores([x or "" for x in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*kept).mapInArrow(rate, f"{schema}, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS, seed: int = SEED) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    seen = labels.where(fold(F.col("doc_id"), folds) != held_out)
    return train(*labelled_sample(docs, seen, "quality", per_class, max_chars, seed), seed=seed)
