"""Near copies by 64-bit SimHash, linked with a Gray-order hierarchical index.

Distinct fingerprints are indexed once for each of ``bits apart + 1`` bands of their bits: two that differ in so few bits agree on one band at least, and the
band's bits are the topmost shared pattern, by which the index is spread over tasks (a fixed number of copies of each fingerprint). Within a task
fingerprints, turned so that the band comes first, are sorted by their rank in the reflected Gray code. Upper nodes hold the bits that all
fingerprints below share (a mask and a pattern); a node keeps only the bits that its parent does not already fix. A search goes down the tree adding
up differing bits and leaves a whole group as soon as the sum exceeds the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from senseloom.llm.common import materialize, maybe_broadcast
from senseloom.llm.components import components

SHINGLE = 3
BITS_APART = 2
#: Fingerprints in a block of the index, and how many may share a band before they are spread again.
BLOCK_ROWS = 20_000
HOT_ROWS = 1_000_000
FANOUT = 8


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers in each column of ``h`` have each bit: (columns, 64), least bit first. Eight bits are added at a time, in bytes."""
    ones = np.zeros((h.shape[1], 64), np.int64)
    mask = np.uint64(0x0101010101010101)
    for a in range(0, len(h), 255 * 1024):
        part = h[a : a + 255 * 1024]
        at = np.arange(0, len(part), 255)  # a byte holds 255
        for s in range(8):
            sums = np.add.reduceat(part >> np.uint64(s) & mask, at, axis=0).astype("<u8")
            ones[:, s::8] += np.ascontiguousarray(sums).view(np.uint8).reshape(len(at), -1, 8).sum(0, dtype=np.int64)
    return ones


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included: bit j is 1 if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        hashes = [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    set_bits = 2 * bit_counts(np.array(hashes, np.uint64)[:, None])[0] > len(hashes)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, text_hash, fp): the fingerprint's 64 bits as a long. A null, empty or blank text has fingerprint 0."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(rate, "doc_id long, text_hash long, fp long")


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Order of codes (rows of 64-bit words, the first one foremost) by their place in the reflected Gray code."""
    rank = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(s))
    for w in range(1, rank.shape[1]):
        rank[:, w] ^= np.uint64(0) - (rank[:, w - 1] & np.uint64(1))  # an odd place so far turns the rest around
    return np.lexsort(rank.T[::-1])


class GrayTree:
    """Hierarchy of shared bit patterns over codes given in Gray order: ``mask`` tells which bits a group shares, ``pattern`` their values.

    Codes are rows of 64-bit words; the first ``fixed`` words must agree.
    """

    def __init__(self, codes: np.ndarray, fixed: int = 0, fanout: int = FANOUT):
        self.fanout, self.fixed = fanout, fixed
        levels = [(np.full(codes.shape, ~np.uint64(0)), codes.astype(np.uint64))]
        while len(levels[-1][0]) > fanout:
            m, p = levels[-1]
            at = np.arange(0, len(m), fanout)
            ones, some = np.bitwise_and.reduceat(p & m, at), np.bitwise_or.reduceat(p, at)
            shared = np.bitwise_and.reduceat(m, at) & ~(ones ^ some)
            levels.append((shared, ones & shared))
        levels.reverse()
        self.levels = [levels[0]]
        for (up, _), (m, p) in zip(levels[:-1], levels[1:], strict=True):
            rest = m & ~up[np.arange(len(m)) // fanout]  # what the parent does not fix already
            self.levels.append((rest, p & rest))

    def search(self, queries: np.ndarray, most: int, chunk: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, leaf) whose accumulated differences are at most ``most``, in chunks of queries."""
        top = len(self.levels[0][0])
        for a in range(0, len(queries), chunk):
            q = queries[a : a + chunk]
            who, node = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q))
            apart = np.zeros(len(who), np.int32)
            for depth, (mask, pattern) in enumerate(self.levels):
                if depth:
                    n = len(mask)
                    who, apart = np.repeat(who, self.fanout), np.repeat(apart, self.fanout)
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    there = node < n
                    who, node, apart = who[there], node[there], apart[there]
                for w in range(q.shape[1]):
                    differ = (q[who, w] ^ pattern[node, w]) & mask[node, w]
                    apart = apart + (np.where(differ != 0, most + 1, 0) if w < self.fixed else np.bitwise_count(differ))
                    near = apart <= most
                    who, node, apart = who[near], node[near], apart[near]
            yield who + a, node


class Forest:
    """Union-find over 0 .. n-1, to keep a spanning forest instead of all pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, low, high = a[apart], b[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(self.root, high, low)
            while (up := self.root[self.root]) is not None and (up != self.root).any():
                self.root = up


def bands_of(bits: int, parts: int) -> list[tuple[int, int]]:
    """Cut ``bits`` bits into ``parts`` bands: (lowest bit, width)."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def band_keys(fp: Column, bands: list[tuple[int, int]]) -> Column:
    """Array of (band, value) structs of a fingerprint column."""
    return F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1).alias("value")) for i, (low, width) in enumerate(bands)))


def block_links(block: pd.DataFrame, most: int, top: int) -> pd.DataFrame:
    """Spanning links (u, v) between the fingerprints of a block that are within ``most`` bits; ``top`` is the end of its band."""
    own = np.unique(block["fp"].to_numpy(np.int64).view(np.uint64))
    turn = np.uint64(64 - top)
    turned = (own if not turn else (own << turn) | (own >> np.uint64(64) - turn))[:, None]
    order = gray_order(turned)
    own, turned = own[order], turned[order]
    forest = Forest(len(own))
    for who, leaf in GrayTree(turned).search(turned, most):
        forest.link(who[who > leaf], leaf[who > leaf])
    moved = np.flatnonzero(forest.root != np.arange(len(own)))
    return pd.DataFrame({"u": own[moved].view(np.int64), "v": own[forest.root[moved]].view(np.int64)})


def fingerprint_links(distinct: DataFrame, most: int = BITS_APART, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``most`` bits of each other, as spanning forests of blocks.

    Every pair within reach is examined; only links that join two groups are kept, so a dense group costs as many rows as it has members. Of a
    band value that more than ``hot_rows`` fingerprints share, the other bits are cut into bands in turn, which is exact again.
    """
    bands = bands_of(64, most + 1)
    n = distinct.count()
    keyed = distinct.select("fp", F.explode(band_keys(F.col("fp"), bands)).alias("key")).select("fp", "key.*", F.lit(-1).alias("band2"), F.lit(0).cast("long").alias("value2"))
    hot = materialize(keyed.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("band", "value", F.lit(True).alias("hot")), "hot")
    if held := hot.count():
        marked = keyed.join(maybe_broadcast(hot, held), ["band", "value"], "left")
        parts = []
        for i, (low, width) in enumerate(bands):
            spread = bands_of(64 - width, most + 1)
            # The other bits, closed up, in bands of their own.
            closed = F.shiftrightunsigned(F.col("fp"), low + width) if low + width < 64 else F.lit(0).cast("long")
            closed = F.shiftleft(closed, low).bitwiseOR(F.col("fp").bitwiseAND((1 << low) - 1))
            one = marked.where((F.col("band") == i) & F.col("hot"))
            parts.append(one.select("fp", "band", "value", F.explode(band_keys(closed, spread)).alias("key")).select("fp", "band", "value", F.col("key.band").alias("band2"), F.col("key.value").alias("value2")))
        keyed = marked.where("hot IS NULL").select("fp", "band", "value", "band2", "value2")
        for part in parts:
            keyed = keyed.unionByName(part)
    blocks = max(1, -(-n // block_rows))
    placed = keyed.select("fp", "band", F.pmod(F.xxhash64("value", "band2", "value2"), F.lit(blocks)).alias("block"))
    tops = [low + width for low, width in bands]

    def link(key: tuple[int, int], block: pd.DataFrame) -> pd.DataFrame:
        return block_links(block, most, tops[key[0]])

    return placed.groupBy("band", "block").applyInPandas(link, "u long, v long")


def _grouped(docs: DataFrame, shingle: int, most: int) -> DataFrame:
    """Rows (doc_id, text_hash, fp, root, component_id): each document's group, named by a fingerprint and by its smallest doc_id."""
    each = materialize(fingerprints(docs, shingle), "simhash")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    group = components(fingerprint_links(distinct.select("fp"), most))
    rooted = distinct.join(group, distinct["fp"] == group["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return each.join(named, "fp")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, most: int = BITS_APART) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id reachable by links.

    Documents link if their fingerprints differ in at most ``most`` bits; equal fingerprints (all blank texts among them) always do.
    Repeated rows are returned as often as they come; a null doc_id takes part but never names a component unless all its members are null.
    Other columns are ignored.
    """
    return _grouped(docs, shingle, most).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
