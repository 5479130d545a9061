"""Packing of token sequences: best-fit decreasing over all pieces of a corpus.

Only the *lengths* decide a best-fit-decreasing layout, and there are at most ``window`` different lengths. So the corpus is
reduced to a histogram of lengths (at most ``window`` rows, the only thing that reaches the driver), the exact layout is
computed there run by run, and every piece then looks up its own place by its ordinal among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from senseloom.llm.common import materialize, slices

WINDOW = 4096
END_ID = 2
#: Words whose ids a Python worker remembers, at least the last so many and at most twice as many; and as many tokens of words that are not letters alone.
CACHE_WORDS = 100_000
#: Bytes of text that are tokenized at once.
SLICE = 4 << 20
#: Pieces of one length are numbered in buckets of about so many.
BUCKET_ROWS = 50_000

# The rules below are those of the tokenizer file for characters below U+0250: letters, numbers, contractions.
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
#: Texts with any of these, as written or in lower case, go whole through the tokenizer itself: some letters below U+0250 have their lower case above it.
_ODD = "[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{130}]|[^\\x{0}-\\x{24f}]|<\\|"


class Recent:
    """What was asked for last: a full generation becomes the older one, and what is found there moves on, so frequent keys stay and rare ones go."""

    def __init__(self):
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def get(self, key: str) -> tuple[int, ...] | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: tuple[int, ...]) -> None:
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def __len__(self) -> int:
        return len(self.new) + len(self.old)


class WordTokenizer:
    """Ids of texts by a word-level BPE file. Each distinct word of a batch is tokenized once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.bytes_to_chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.words, self.tokens = Recent(), Recent()

    def _ids(self, token: str) -> tuple[int, ...]:
        known = token if token.isascii() and token.isalnum() else token.encode().decode("latin-1").translate(self.bytes_to_chars)
        return tuple([x.id for x in self.model.tokenize(known)])

    def _token(self, token: str) -> tuple[int, ...]:
        ids = self.tokens.get(token)
        if ids is None:
            self.tokens.put(token, ids := self._ids(token))
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            self.words.put(word, ids := self._ids(word) if word.isalpha() else tuple([i for t in _TOKEN.findall(word) for i in self._token(t)]))
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (int32), and how many each text has."""
        lower = pc.utf8_lower(texts)
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.match_substring_regex(lower, _ODD)).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", lower))
        words = lists.flatten().dictionary_encode()
        ids = [self._word(w) for w in words.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        used = words.indices.to_numpy()
        lengths = sizes[used]
        ends = np.cumsum(lengths)
        out = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[used] - (ends - lengths), lengths)]
        of_text = np.diff(np.r_[0, ends][lists.offsets.to_numpy()])
        if odd.any():
            parts = np.split(out, np.cumsum(of_text)[:-1])
            for i in np.flatnonzero(odd):
                parts[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
                of_text[i] = len(parts[i])
            out = np.concatenate(parts)
        return out, of_text


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, emit: str = "ids") -> DataFrame:
    """Cut every document into full windows and a rest.

    One row per piece: ``doc_id``, ``start`` (its document's ids before it), ``length``, ``doc_tokens`` (all ids of the document,
    its end id included) and ``ids`` (array of int) or, with ``emit="crc32"``, ``ids_crc32`` of the little-endian unsigned 32-bit ids.
    A null or empty text is the end id alone. Repeated rows are cut each on its own; other columns are ignored.
    """
    if emit not in ("ids", "crc32"):
        raise ValueError("emit must be 'ids' or 'crc32'")
    last = pa.list_(pa.int32()) if emit == "ids" else pa.int64()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what an earlier task of this worker has left
        tokenizer = WordTokenizer(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
                ids, sizes = tokenizer.encode(texts)
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                sizes = sizes + 1
                pieces = -(-sizes // window)
                row = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, sizes[row] - start)
                bounds = np.r_[0, np.cumsum(length)]
                if emit == "ids":
                    value = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                else:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    value = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sizes[row], pa.int64()), value],
                    schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), (name, last)]),
                )

    name = "ids" if emit == "ids" else "ids_crc32"
    kind = "array<int>" if emit == "ids" else "long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, f"doc_id long, start long, length long, doc_tokens long, {name} {kind}")


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree that finds the tightest one that is large enough."""

    def __init__(self, window: int):
        self.window, self.size = window, 1 << window.bit_length()
        self.tree = [False] * (2 * self.size)
        self.runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)

    def put(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.runs[left].append((first, n))
            if not self.tree[i := left + self.size]:
                while i and not self.tree[i]:
                    self.tree[i], i = True, i >> 1

    def take(self, left: int) -> tuple[int, int]:
        found = self.runs[left].popleft()
        if not self.runs[left]:
            i = left + self.size
            self.tree[i] = False
            while (i := i >> 1) and not (self.tree[2 * i] or self.tree[2 * i + 1]):
                self.tree[i] = False
        return found

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that some open window has."""
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """The best-fit-decreasing layout of ``counts[length]`` pieces, as runs.

    A run (length, first, n, sequence, each, offset) puts the pieces with ordinals first .. first+n-1 of that length into sequences
    from ``sequence`` on, ``each`` per sequence, the first at ``offset``. Pieces of one length are alike, so a window that takes one
    takes as many as fit before the next window is tried: then it is the tightest. Runs are few: they follow lengths, not pieces.
    """
    windows, runs, opened = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"no window of {window} holds a piece of {length}")
        first, left = 0, counts[length]
        while left:
            room = windows.tightest(length)
            each = (window if room is None else room) // length
            sequence, n = (opened, -(-left // each)) if room is None else windows.take(room)
            if room is None:
                room, opened = window, opened + n
            full = min(n, left // each)
            if full:
                runs.append((length, first, full * each, sequence, each, window - room))
                windows.put(room - each * length, sequence, full)
                first, left = first + full * each, left - full * each
            if n > full and left:
                runs.append((length, first, left, sequence + full, left, window - room))
                windows.put(room - left * length, sequence + full, 1)
                first, left, full = first + left, 0, full + 1
            windows.put(room, sequence + full, n - full)
    return runs


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset`` by best-fit decreasing over all pieces.

    ``pieces`` has ``doc_id``, ``start`` and ``length`` (from 1 to ``window``); its other columns are kept. Ties between pieces of one
    length go by bucket, doc_id (null first) and start; rows alike in all of these are interchangeable. An empty table gives an empty table.
    The driver sees one count per length. A length that holds a third of all pieces is numbered in many buckets.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_decreasing(counts, window)
    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    # Where the pieces have a digest or ids, pieces of one (or no) doc_id are spread by these too.
    told = [c for c in ("ids_crc32", "ids") if c in pieces.columns]
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", *told), F.lit(buckets)).cast("int"))
    before = (
        keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
        .withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    ordinal = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")).cast("long") - 1 + F.col("_before")
    numbered = keyed.join(before, ["length", "_bucket"]).withColumn("_ordinal", ordinal).drop("_before", "_bucket")
    # Few runs per length, broadcast: pieces and their ids are placed where they are and never leave the JVM.
    plan = F.broadcast(spark.createDataFrame(runs, "_length long, _first long, _n long, _sequence long, _each long, _offset long"))
    placed = numbered.join(plan, (F.col("length") == F.col("_length")) & (F.col("_ordinal") >= F.col("_first")) & (F.col("_ordinal") < F.col("_first") + F.col("_n")))
    nth = F.col("_ordinal") - F.col("_first")
    sequence, offset = F.col("_sequence") + F.floor(nth / F.col("_each")), F.col("_offset") + nth % F.col("_each") * F.col("_length")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*kept, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, emit: str = "ids") -> DataFrame:
    """Tokenize, cut and pack documents; see :func:`token_pieces` and :func:`pack`."""
    return pack(token_pieces(docs, tokenizer_path, window, end_id, emit), window)
