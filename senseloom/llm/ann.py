"""Nearest neighbours by inner product: an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and residual codebooks are fitted on a bounded sample. Every row is then indexed (list, code), with the distance between the row and what its code stands for; of each list the
largest distance of a row from the centroid is known. So no list and no row is left out by a measured share, which would hold only for rows like those that it was measured on: a query visits every list
that can hold a neighbour as near as its k-th in the sample, and there every row is reranked that its code does not rule out. What is found is exact, whatever the rows.

Lists whose centroids lie together form groups of bounded size; a very long list is cut into chunks, so it is many tasks. A query is sent once to each group that holds some of its lists; there the rows of
these lists, and no others, are scored by asymmetric distance tables (one look-up per subspace). The best are reranked at once with their original vectors in double precision, then those whose
score with the code's error reaches the k-th of these, so only the nearest of each group travel on. Rows that repeat one vector count as one in the scores and are taken in order of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from senseloom.llm.common import materialize

SEED = 7
SAMPLE_ROWS = 20_000
#: Lists grow with the square root of the table, up to so many.
LISTS_PER_ROOT = 4
MOST_LISTS = 4_096
#: Rows of a group (a list of more is cut), queries that meet them in one task, and into how many groups a small table is cut.
TILE_ROWS = 131_072
GROUPS = 12
#: Rounding of double precision in a sum of products, relative to the lengths, with room to spare.
SLACK = 1e-9
SHORTLIST = 200
SUBSPACES = 16
CODES = 256


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) that take part: no null id, vector or component, all components finite, not all zero, of the most common length.

    Repeated rows of an id count once (of different vectors the least).
    """
    known = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    known = known.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = known.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return known.where(F.size("v") == (common["dim"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster starts again at a random row."""
    k = max(1, min(k, len(x)))
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        centre = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], x[rng.integers(0, len(x), k)]).astype(x.dtype)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (centre**2).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + block] @ centre.T - half, 1) for a in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    lists: np.ndarray  # (lists, dim)
    scale: np.ndarray  # of each list, the size of its residuals: dense lists are coded as finely as loose ones
    codebooks: list[np.ndarray]  # of each subspace (codes, width)
    bounds: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, subspaces: int = SUBSPACES, seed: int = SEED) -> Index:
        """Centroids and codebooks from a sample of a table of ``rows`` rows."""
        rng = np.random.default_rng(seed)
        lists = kmeans(sample, int(min(MOST_LISTS, max(1, LISTS_PER_ROOT * rows**0.5), max(1, len(sample) // 4))), 8, rng)
        home = nearest(sample, lists)
        rest = sample - lists[home]
        square = (rest**2).sum(1)
        scale = np.sqrt(np.bincount(home, square, len(lists)) / np.maximum(1, np.bincount(home, minlength=len(lists)))).astype(np.float32)
        scale = np.where(scale > 1e-6 * (1 + scale.max()), scale, np.float32(np.sqrt(square.mean()) or 1))
        rest /= scale[home][:, None]
        bounds = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        return cls(lists, scale, [kmeans(rest[:, a:b], CODES, 8, rng) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], bounds)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row (in double precision) its list, its code, and bounds of its distances from the list's centroid and from what the code stands for."""
        home = nearest(x.astype(np.float32), self.lists)
        centre = self.lists[home].astype(np.float64)
        rest = (x - centre) / self.scale[home][:, None]
        parts = [nearest(rest[:, a:b].astype(np.float32), book) for a, b, book in zip(self.bounds[:-1], self.bounds[1:], self.codebooks, strict=True)]
        coded = np.concatenate([book[i] for book, i in zip(self.codebooks, parts, strict=True)], 1).astype(np.float64) * self.scale[home][:, None]
        size = SLACK * (length(x) + length(centre) + length(coded))
        return home, np.stack(parts, 1).astype(np.uint8), length(x - centre) + size, length(x - centre - coded) + size

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query the inner products with all codes of all subspaces, in a row."""
        return np.concatenate([q[:, a:b] @ np.pad(book, ((0, CODES - len(book)), (0, 0))).T.astype(np.float64) for a, b, book in zip(self.bounds[:-1], self.bounds[1:], self.codebooks, strict=True)], 1)


def length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def floor_of(q: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """Of each query the score of its k-th nearest row of the sample, itself left out: its k-th nearest of all rows scores no less."""
    if len(sample) <= k:
        return np.full(len(q), -np.inf)
    score = q @ sample.T
    score[ids[:, None] == sample_ids] = -np.inf
    return np.partition(score, len(sample) - k, 1)[:, len(sample) - k] - SLACK * length(q) * length(sample).max()


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float32) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest, ties to the earlier place."""
    if len(score) <= n:
        return np.arange(len(score))
    least = np.partition(score, len(score) - n)[len(score) - n]
    above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
    return np.concatenate([above, equal[: n - len(above)]])


def early(x: np.ndarray, n: int) -> np.ndarray:
    """Mark the first ``n`` rows of each group of equal rows of one list: later copies can be nobody's neighbours. Rows come by list and id, and equal rows share a list."""
    _, which, count = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    nth = np.empty(len(x), np.int64)
    nth[order] = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
    return nth < n


def deal(lists: np.ndarray, sizes: np.ndarray, most: int) -> list[list[int]]:
    """Give each list a group of about ``most`` rows, near lists the same one; a list of more rows gets several groups, each for a part of its rows.

    Lists are halved by rows along the direction in which their centroids spread most, until a part is small enough.
    """
    out: list[list[int]] = [[] for _ in sizes]
    groups = 0
    todo = [np.arange(len(sizes))]
    while todo:
        part = todo.pop()
        rows = int(sizes[part].sum())
        if rows > most and len(part) > 1:
            x = lists[part] - lists[part].mean(0)
            order = part[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(sizes[order]), rows / 2) + 1, 1, len(part) - 1))
            todo += [order[half:], order[:half]]
            continue
        n = max(1, -(-rows // most))
        for i in part:
            out[i] = list(range(groups, groups + n))
        groups += n
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, shortlist: int = SHORTLIST, sample_rows: int = SAMPLE_ROWS, tile_rows: int = TILE_ROWS, seed: int = SEED) -> DataFrame:
    """The ``k`` nearest of each query row among all other rows: query_id, rank (from 1), vec_id, score (inner product in double precision).

    ``vectors`` has vec_id and embedding, ``is_query`` selects queries by vec_id. See :func:`usable` for the rows that take part; an empty table gives no rows. Ties go
    to the smaller vec_id. Columns other than those two are ignored. ``shortlist`` rows are reranked first in each group; how many follow depends on how finely the codes tell the rows apart.

    A group's vectors are copied once for each ``tile_rows`` queries; a task then scores up to that many rows for that many queries, so the copies are
    small beside the work.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    n, asked = rows.count(), rows.where(is_query).count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vector = rows.schema["v"].dataType.simpleString()
    kind = np.float32 if vector == "array<float>" else np.float64
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample_rows).toArrow()
    sample = matrix(drawn.column("v"), kind)
    sent = spark.sparkContext.broadcast(Index.fit(sample.astype(np.float32), n, seed=seed))
    known = spark.sparkContext.broadcast((drawn.column("vec_id").to_numpy(), sample))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                home, codes, reach, error = sent.value.encode(matrix(b.column("v"), np.float64))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(home.astype(np.int32)), pa.array(list(map(bytes, codes)), pa.binary()), pa.array(reach), pa.array(error)], names=["vec_id", "v", "list", "code", "reach", "error"])

    coded = materialize(rows.mapInArrow(encode, f"vec_id long, v {vector}, list int, code binary, reach double, error double"), "codes")
    counted = {r["list"]: r for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect()}  # a row per list
    lists = sent.value.lists
    sizes = np.array([counted[i]["n"] if i in counted else 0 for i in range(len(lists))])
    reaches = np.array([counted[i]["reach"] if i in counted else 0.0 for i in range(len(lists))])
    group_of = deal(lists, sizes, max(1, min(tile_rows, -(-n // GROUPS))))
    parts = max(1, -(-asked // tile_rows))
    plan = spark.sparkContext.broadcast((sizes, reaches, group_of))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = plan.value[2]
        for b in batches:
            group = [groups[i][h % len(groups[i])] for i, h in zip(b.column("list").to_pylist(), b.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *(b.column(c) for c in ("vec_id", "v", "list", "code", "error"))], names=["group", "vec_id", "v", "list", "code", "error"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, reach, groups = plan.value
        sample_ids, sample = known.value[0], known.value[1].astype(np.float64)
        centres = sent.value.lists.astype(np.float64)
        holds = np.zeros((1 + max(max(x) for x in groups), len(size)), bool)
        for i, x in enumerate(groups):
            holds[x, i] = size[i] > 0
        used = np.flatnonzero(holds.any(1))
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                q = matrix(b.column("v"), np.float64)
                floor = floor_of(q, b.column("vec_id").to_numpy(), sample, sample_ids, k)
                wanted = ~(q @ centres.T + length(q)[:, None] * reach < floor[:, None])  # what cannot be compared is visited
                for g in used:
                    here = wanted & holds[g]
                    who = np.flatnonzero(here.any(1))
                    if not len(who):
                        continue
                    lists = [np.flatnonzero(x).astype(np.int16) for x in here[who]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), g, np.int32)), b.column("vec_id").take(pa.array(who)), b.column("v").take(pa.array(who)), pa.array(floor[who]), pa.array(lists, pa.list_(pa.int16()))], names=["group", "query_id", "q", "floor", "lists"])

    part = F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.lit(parts)).cast("int")
    visits = rows.where(is_query).select("vec_id", "v").mapInArrow(visit, f"group int, query_id long, q {vector}, floor double, lists array<smallint>").withColumn("part", part)
    stored = coded.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))).mapInArrow(place, f"group int, vec_id long, v {vector}, list int, code binary, error double")
    stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def scan(asked: pa.Table, stored: pa.Table) -> pa.Table:
        found = []
        if stored.num_rows and asked.num_rows:
            stored = stored.sort_by([("list", "ascending"), ("vec_id", "ascending")])
            v = matrix(stored.column("v"), kind)
            stored, v = stored.filter(pa.array(first := early(v, k + 1))), v[first]
            ids, home, error = (stored.column(c).to_numpy() for c in ("vec_id", "list", "error"))
            codes = np.frombuffer(b"".join(stored.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            look = codes + np.arange(codes.shape[1], dtype=np.int32) * CODES
            scale = sent.value.scale.astype(np.float64)[home]
            starts = np.searchsorted(home, np.arange(len(sent.value.lists) + 1))
            for a in range(0, asked.num_rows, 256):
                some = asked.slice(a, 256)
                q, floor, who = matrix(some.column("q"), np.float64), some.column("floor").to_numpy(), some.column("query_id").to_pylist()
                tables, centres = sent.value.tables(q), q @ sent.value.lists.T.astype(np.float64)
                for i, lists in enumerate(some.column("lists").to_pylist()):
                    rows = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in lists])
                    rows = rows[ids[rows] != who[i]]
                    score = tables[i][look[rows]].sum(1) * scale[rows] + centres[i][home[rows]]
                    top = rows[best(score, shortlist)]
                    near = (v[top] * q[i]).sum(1)
                    least = max(floor[i], np.partition(near, len(near) - k)[len(near) - k]) if len(near) >= k else floor[i]
                    top = np.union1d(top, rows[~(score + np.sqrt((q[i] ** 2).sum()) * error[rows] < least)])
                    inner = np.concatenate([(v[top[c : c + 4096]] * q[i]).sum(1) for c in range(0, len(top), 4096)]) if len(top) else np.zeros(0)
                    order = np.lexsort((ids[top], -inner))[:k]
                    found.append((np.full(len(order), who[i]), ids[top][order], inner[order]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(x) for x in columns], names=["query_id", "vec_id", "score"])

    scanned = visits.groupBy("group", "part").cogroup(stored.groupBy("group", "part")).applyInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scanned.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
