"""SimHash near-dedup at a similarity: documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

The fingerprints and the Gray-order index are those of :mod:`senseloom.llm.simhash`, with more bits. A bit of two texts agrees with probability 1 - angle / pi, which a similarity
of 0.8 puts at 0.85. Fingerprints are indexed under several bands of their bits, wide enough for few texts to share a band by chance and so many that texts of that
similarity miss all of them in one case of a hundred; within a band the tree finds those within a radius of 128 further bits. What it finds are candidates: they join
into groups, and within a group exact similarities of shingle sets decide which texts are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from senseloom.llm.common import materialize, maybe_broadcast
from senseloom.llm.components import components
from senseloom.llm.simhash import Forest, GrayTree, bit_counts, gray_order

SHINGLE = 5
SIMILARITY = 0.8
#: Share of texts of just that similarity that are to meet in a band; standard deviations beyond the mean number of differing bits that are looked for.
RECALL = 0.99
BEYOND = 2.5
#: Words of 64 bits whose differences are counted.
NEAR_WORDS = 2
#: Entries of the index in one task; entries of one band value beyond which it is cut into parts that meet in pairs.
BLOCK_ROWS = 20_000
HOT_ROWS = 10_000
#: Texts of a group that are compared in one task, and rows of small groups that share one.
UNIT = 1_000
UNIT_ROWS = 4_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``shingle`` lower-case words, in order; a shorter text is one run, one without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - shingle + 1)
    out = np.full(n, min(len(h), shingle), np.uint64)
    for i in range(min(len(h), shingle)):
        out = out * _P + h[i : i + n]
    out ^= out >> np.uint64(29)
    return np.unique(out * _P)


def layout(texts: int, least: float = SIMILARITY) -> tuple[int, int, int]:
    """Bits of a band, bands, and the radius in the further bits, for so many texts."""
    agree = 1 - acos(2 * least / (1 + least)) / pi
    width = min(60, max(8, ceil(log2(max(2, texts))) - 5))
    bands = max(1, ceil(log(1 - RECALL) / log(1 - agree**width)))
    bits = 64 * NEAR_WORDS
    return width, bands, int(bits * (1 - agree) + BEYOND * sqrt(bits * agree * (1 - agree)))


def bits_of(hashes: np.ndarray, words: int, chunk: int = 1 << 14) -> np.ndarray:
    """SimHash of a set of 64-bit hashes in ``words`` times 64 bits, each word from a mixture of its own."""
    factor = _P * (2 * np.arange(words, dtype=np.uint64) + np.uint64(1))
    ones = np.zeros((words, 64), np.int64)
    for a in range(0, len(hashes), chunk):
        x = hashes[a : a + chunk, None] * factor
        x = (x ^ (x >> np.uint64(32))) * _Q
        ones += bit_counts(x ^ (x >> np.uint64(29)))
    return (2 * ones > len(hashes)).ravel()


def signatures(texts: DataFrame, width: int, bands: int) -> DataFrame:
    """Rows (text_hash, near: array of NEAR_WORDS longs, keys: a value for each band) from (text_hash, text)."""
    words = NEAR_WORDS + -(-width * bands // 64)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(width, dtype=np.int64)
        for b in batches:
            bits = np.stack([bits_of(shingles(x.as_py()), words) for x in b.column(1)]) if b.num_rows else np.zeros((0, words * 64), bool)
            near = np.packbits(bits[:, : 64 * NEAR_WORDS], axis=1).view(">i8").astype(np.int64)
            keys = bits[:, 64 * NEAR_WORDS :][:, : width * bands].reshape(-1, bands, width) @ power
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (near, keys)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["text_hash", "near", "keys"])

    return texts.select("text_hash", "text").mapInArrow(rate, "text_hash long, near array<long>, keys array<long>")


def candidate_links(signed: DataFrame, texts: int, bands: int, most: int, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (u, v) that join all texts which share a band's value and differ in at most ``most`` of the further bits, as spanning forests of blocks.

    A band value that more than ``hot_rows`` texts share is cut into parts of about that many, and each pair of parts is a group of its own: a text travels once for each part, and every two texts of the
    value meet.
    """
    value = F.transform("keys", lambda v, i: F.struct(i.alias("band"), v.alias("value")))
    entries = signed.select("text_hash", "near", F.explode(value).alias("e")).select("text_hash", "near", "e.*")
    counted = entries.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = materialize(counted.select("band", "value", "n", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")), "hot")
    key, n = F.xxhash64("band", "value"), texts * bands
    if held := hot.count():
        n += hot.agg(F.sum(F.col("n") * (F.col("parts") - 1))).first()[0]
        parts = F.coalesce("parts", F.lit(1))
        entries = entries.join(maybe_broadcast(hot.drop("n"), held), ["band", "value"], "left").withColumn("own", F.pmod(F.xxhash64("text_hash"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        key = F.when(F.col("parts").isNull(), key).otherwise(F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")))
    keyed = entries.select("text_hash", key.alias("key"), *(F.col("near")[i].alias(f"n{i}") for i in range(NEAR_WORDS)))
    placed = keyed.withColumn("block", F.pmod("key", F.lit(max(1, -(-n // block_rows)))).cast("int"))

    def link(block: pd.DataFrame) -> pd.DataFrame:
        codes = block[["key", *(f"n{i}" for i in range(NEAR_WORDS))]].to_numpy(np.int64).view(np.uint64)
        order = gray_order(codes)
        codes, name = codes[order], block["text_hash"].to_numpy()[order]
        forest = Forest(len(codes))
        for who, leaf in GrayTree(codes, fixed=1).search(codes, most, 256):
            forest.link(who[who > leaf], leaf[who > leaf])
        moved = np.flatnonzero(forest.root != np.arange(len(codes)))
        return pd.DataFrame({"u": name[moved], "v": name[forest.root[moved]]})

    return placed.groupBy("block").applyInPandas(link, "u long, v long")


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Of each pair of sets how many elements they share, by products of blocks of the incidence matrix."""
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1  # elements of one set alone do not count
    kept = n[place] > 1
    who, place = who[kept], rank[place[kept]]
    order = np.argsort(place, kind="stable")
    who, place = who[order], place[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, (a, a + columns))
        x = np.zeros((len(sets), columns), np.float32)
        x[who[lo:hi], place[lo:hi] - a] = 1
        shared += x @ x.T
    return shared


def exact_links(candidates: DataFrame, texts: DataFrame, least: float = SIMILARITY, unit: int = UNIT) -> DataFrame:
    """Links (u, v) that join all texts of a candidate group (node, root) which are alike to ``least`` or more, as spanning forests.

    A group of up to ``unit`` texts is compared in one task. A larger one is cut into parts and each pair of parts is a task, so a text travels once for each part; no pair is
    written, only the links that join.
    """
    sized = candidates.join(maybe_broadcast(candidates.groupBy("root").agg(F.ceil(F.count("*") / unit).cast("int").alias("parts")).where("parts > 1")), "root", "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    units = sized.select("node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    units = units.select(F.col("node").alias("text_hash"), F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("unit"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                found = [shingles(x.as_py()).view(np.int64) for x in part.column(1)]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["text_hash", "shingles"])

    sets = texts.select("text_hash", "text").join(candidates.select(F.col("node").alias("text_hash")), "text_hash", "left_semi").mapInArrow(cut, "text_hash long, shingles array<long>")
    units = materialize(units, "units")
    blocks = max(1, -(-units.count() // UNIT_ROWS))
    placed = materialize(sets, "shingles").join(units, "text_hash").withColumn("block", F.pmod("unit", F.lit(blocks)).cast("int"))

    def link(block: pa.Table) -> pa.Table:
        block = block.sort_by("unit")
        unit, names = block.column("unit").to_numpy(), block.column("text_hash").to_numpy()
        lists = block.column("shingles").combine_chunks()
        flat, at = lists.flatten().to_numpy(), np.r_[0, np.cumsum(np.fromiter((len(x) for x in lists), np.int64, len(lists)))]
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bounds = np.r_[0, np.flatnonzero(np.diff(unit)) + 1, len(unit)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            sets = [flat[at[i] : at[i + 1]] for i in range(a, b)]
            size = np.array([len(x) for x in sets])
            shared = shared_counts(sets) if b - a > 2 else np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)), np.float32)
            x, y = np.nonzero(np.triu(shared >= least * (size[:, None] + size - shared) - 1e-6, 1))
            forest = Forest(b - a)
            forest.link(y, x)
            moved = np.flatnonzero(forest.root != np.arange(b - a))
            u.append(names[a + moved])
            v.append(names[a + forest.root[moved]])
        return pa.table([np.concatenate(u), np.concatenate(v)], names=["u", "v"])

    return placed.select("block", "unit", "text_hash", "shingles").groupBy("block").applyInArrow(link, "u long, v long")


def groups(texts: DataFrame, least: float = SIMILARITY, unit: int = UNIT) -> DataFrame:
    """Rows (text_hash, root) of the texts that are linked to another text; ``texts`` has each text once, with its ``text_hash``."""
    n = texts.count()
    width, bands, most = layout(n, least)
    signed = materialize(signatures(texts, width, bands), "signatures")
    candidates = materialize(components(candidate_links(signed, n, bands, most)), "candidates")
    return components(exact_links(candidates, texts, least, unit)).select(F.col("node").alias("text_hash"), "root")


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Keep one document of each group of near copies: that of the smallest doc_id (null last), of one id's texts that of the smallest hash.

    ``docs`` has doc_id and text. Texts without words are copies of each other, null among them. Documents of different groups stay, even under one id or without one.
    Of rows alike in id and text one stays, whichever its other columns. All columns are kept, whatever their names; an empty table gives an empty one. Exact copies are
    one text from the start, so a group of them costs a row per task.
    """
    # Texts without words have one hash in common. The row travels as a struct, so that no name of its columns meets one of ours.
    words = F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]"))
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.when(words, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("text_hash"))
    place = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    firsts = materialize(marked.groupBy("text_hash").agg(place.alias("first")), "firsts")
    kept = lambda places: marked.join(places.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_of")), (F.col("text_hash") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # Of each text the row of its first id; rows alike in both are one.
    texts = materialize(kept(firsts).where("text_hash <> 0").select("text_hash", F.col("_row.text").alias("text")).dropDuplicates(["text_hash"]), "texts")
    linked = groups(texts, least)
    rooted = firsts.join(linked, "text_hash", "left").select(F.coalesce("root", "text_hash").alias("root"), "first")
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return kept(chosen).dropDuplicates(["doc_id", "text_hash"]).select("_row.*")
