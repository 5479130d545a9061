"""Toxicity: a bag of subword vectors, averaged, under a linear softmax; vectors and softmax are trained jointly in numpy.

Texts are lower-cased and cut into words (runs of letters, digits and non-ASCII characters). A word's subwords are its byte n-grams,
word boundaries included, hashed into ``2**bits`` vectors, so an unseen misspelling shares most of its vectors with the word it hides.
Vectors are averaged over each stretch of ``stretch`` words and a document is as toxic as its worst stretch: one insult in
a long document is not averaged away, and all of the text counts.
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

#: Documents of either class to learn from, and the longest text that is drawn.
SAMPLE_PER_CLASS = 2_000
SAMPLE_CHARS = 20_000
SEED = 10

_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Subwords:
    """Subwords of a batch of texts: of each n-gram its bucket and word; of each word its stretch; of each stretch its text. Buckets and words are as narrow as they can be, since a sample is held whole while it is trained on."""

    bucket: np.ndarray
    word: np.ndarray
    stretch: np.ndarray
    text: np.ndarray


def subwords(texts: list[str], bits: int, orders: tuple[int, ...], stretch: int) -> Subwords:
    raw = [x.lower().encode() for x in texts]
    buffer = np.frombuffer(b" " + b"  ".join(raw) + b"  " + b" " * max(orders), np.uint8)
    sizes = np.array([len(x) for x in raw], np.int64)
    begins = 1 + np.cumsum(sizes + 2) - (sizes + 2)
    gap = _BREAK[buffer]
    buffer = np.where(gap, np.uint8(32), buffer)
    start = ~gap[1:] & gap[:-1]
    word_at = np.cumsum(np.r_[False, start], dtype=np.int32) - np.int32(1)  # of each letter its word; of a gap the word before
    text_of_word = np.searchsorted(begins, np.flatnonzero(start) + 1, "right") - 1
    nth = np.arange(len(text_of_word)) - np.searchsorted(text_of_word, np.arange(len(texts)))[text_of_word]
    new = np.r_[True, (np.diff(text_of_word) > 0) | (nth[1:] % stretch == 0)] if len(nth) else np.zeros(0, bool)
    buckets, words = [], []
    n = len(buffer) - max(orders)
    h = np.zeros(n, np.uint32)
    inner = np.zeros(n, bool)  # a gap strictly inside
    for k in range(1, max(orders) + 1):
        h = h * np.uint32(0x01000193) + buffer[k - 1 : n + k - 1].astype(np.uint32) + np.uint32(1)
        if k > 2:
            inner |= gap[k - 2 : n + k - 2]
        if k in orders:
            at = np.flatnonzero(~inner)
            buckets.append(((h[at] ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)).astype(np.uint16 if bits <= 16 else np.uint32))
            words.append(word_at[at + 1])
    return Subwords(np.concatenate(buckets), np.concatenate(words), np.cumsum(new) - 1, text_of_word[new])


@dataclass
class Model:
    value: np.ndarray  # of each bucket, its vector times the difference of the softmax's two rows
    bias: float
    bits: int
    orders: tuple[int, ...]
    stretch: int

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of each text the logit of its worst stretch; a text without words has the bias alone.

        Texts of more than a million characters are read in parts, cut between words, so memory is bounded; the worst stretch of any part counts.
        """
        out = np.full(len(texts), -np.inf)
        for of, parts in batched_parts(texts):
            s = subwords(parts, self.bits, self.orders, self.stretch)
            np.maximum.at(out, np.array(of)[s.text], stretch_logits(s, self.value) + self.bias)
        return np.where(np.isinf(out), self.bias, out)


def stretch_logits(s: Subwords, value: np.ndarray) -> np.ndarray:
    """Mean over each stretch of its subwords' values."""
    if not len(s.text):
        return np.zeros(0)
    of = s.stretch[s.word]
    return np.bincount(of, value[s.bucket], len(s.text)) / np.maximum(1, np.bincount(of, minlength=len(s.text)))


def train(texts: list[str], labels: list[float], bits: int = 16, dim: int = 16, orders: tuple[int, ...] = (3, 4, 5, 6), stretch: int = 2, steps: int = 450, batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = SEED) -> Model:
    """Adam on the log loss of each document's worst stretch; for the first seventh of the steps, of all its stretches, weighted alike.

    Small samples are gone through more often, so that there are always about ``steps`` steps. Without both classes the model is the prior alone.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << bits, dim))
    soft = np.stack([-(w := rng.normal(0, 0.5, dim)), w], 1)  # of the two classes
    bias = np.zeros(2)
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(1 << bits), float(np.log(p / (1 - p))), bits, orders, stretch)
    order = rng.permutation(len(y))
    batches = [(subwords([texts[i] for i in order[a : a + batch]], bits, orders, stretch), y[order[a : a + batch]]) for a in range(0, len(y), batch)]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, soft, bias)]
    step = 0
    epochs = max(1, -(-steps // len(batches)))
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            s, gold = batches[b]
            if not len(s.text):
                continue
            logit = stretch_logits(s, vectors @ (soft[:, 1] - soft[:, 0])) + bias[1] - bias[0]
            if 7 * epoch < epochs:
                weight = 1 / np.bincount(s.text, minlength=len(gold))[s.text]
            else:
                ranked = np.lexsort((-logit, s.text))
                weight = np.zeros(len(logit))
                weight[ranked[np.r_[True, np.diff(s.text[ranked]) > 0]]] = 1
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - gold[s.text]) * weight / len(gold)
            of = s.stretch[s.word]
            used = slope[of] != 0
            of = of[used]
            share = np.bincount(s.bucket[used], (slope / np.maximum(1, np.bincount(of, minlength=len(slope))))[of], 1 << bits)
            toward = vectors.T @ share
            grads = [np.outer(share, soft[:, 1] - soft[:, 0]) + decay * vectors, np.stack([-toward, toward], 1) + decay * soft, np.array([-slope.sum(), slope.sum()])]
            step += 1
            for x, g, (m, v) in zip((vectors, soft, bias), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), bits, orders, stretch)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row; a null text is an empty one. Repeated rows share a score, an empty table gives an empty one.

    The model (a number per bucket) is broadcast; its size is fixed by ``bits``. Columns of those names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                p = 1 / (1 + np.exp(-np.clip(sent.value.logits([x or "" for x in b.column("text").to_pylist()]), -40, 40)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*kept).mapInArrow(rate, f"{schema}, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS, seed: int = SEED) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    seen = labels.where(fold(F.col("doc_id"), folds) != held_out)
    return train(*labelled_sample(docs, seen, "toxic", per_class, max_chars, seed), seed=seed)
