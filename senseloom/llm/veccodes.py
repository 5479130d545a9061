"""Vector code compression: product quantisation with integer arithmetic over deduplicated parts.

Components become integers, vectors are cut into equal parts, and equal integer parts of one position become one weighted row. Lloyd's rounds run over those rows: a
task assigns its rows to the nearest entries of a small codebook and returns one partial sum per entry, so a round moves a few hundred numbers per task and the driver
holds codebooks alone. After the last round codes and errors are joined back to the vectors. Integers make sums exact in any order, so reruns and other partitionings give the same codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from senseloom.llm.common import materialize, maybe_broadcast

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
_MOST = (1 << 63) - 1

Codebooks = list[np.ndarray]  # for each part: entries by width


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, parts): each usable vector's components as floor(scale * x), cut into ``parts`` equal consecutive parts; one row per row, written to the shared folder.

    Vectors that are shorter than the longest one, or of a length that ``parts`` does not divide, are filled up with zeros at the end. Integers whose squared distances could exceed a long
    (for 64 components 2^27 and more, |x| of 32,768 and more) are cut to that.
    """
    good = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    longest = good.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    most = isqrt(_MOST // (4 * max(1, width * parts)))
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-most))), F.lit(float(most)))).cast("long"))
    filled = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("v")))
    cut = F.array(*(F.slice(F.col("whole"), i * width + 1, width) for i in range(parts))) if width else F.array(*(F.array().cast("array<long>") for _ in range(parts)))
    return materialize(good.withColumn("whole", filled).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", cut.alias("parts")), "integers")


def distinct_parts(pieces: DataFrame) -> DataFrame:
    """(part, piece, weight): equal pieces of one position are counted before and after the shuffle, so a vector that a third of the rows share is one row here."""
    return materialize(pieces.groupBy("part", "piece").agg(F.count("*").alias("weight")), "distinct")


def first_codebooks(ints: DataFrame, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors of the smallest ids (null last, equal ids by their parts): one entry each, fewer if there are fewer vectors."""
    rows = ints.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    return [np.array([r["parts"][p] for r in rows], np.int64).reshape(len(rows), -1) for p in range(len(rows[0]["parts"]))] if rows else []


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row by squared Euclidean distance, ties to the lower index, and that distance; exact in integers."""
    far = np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)
    code = far.argmin(1)
    return code, far[np.arange(len(x)), code]


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, places, rows as a matrix) of a batch's pieces."""
    part, pieces = batch.column("part").to_numpy(), batch.column("piece")
    matrix = pieces.flatten().to_numpy().reshape(len(part), -1)
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield int(p), at, matrix[at]


def next_codebooks(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """One weighted round of Lloyd: each entry becomes floor(sum / count) of its pieces by component; entries without any stay."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            weight = b.column("weight").to_numpy()
            for p, at, x in _by_part(b):
                code, _ = nearest_entries(x, books[p])
                kind = np.int64 if x.size == 0 or int(np.abs(x).max()) * int(weight.sum()) < 1 << 62 else object
                for c in np.unique(code):
                    own = at[code == c]
                    total = (x[code == c].astype(kind) * weight[own, None]).sum(0)
                    held = sums.setdefault((p, int(c)), [0, [0] * x.shape[1]])
                    held[0] += int(weight[own].sum())
                    held[1] = [a + int(v) for a, v in zip(held[1], total, strict=True)]
        rows = [(p, c, i, n, Decimal(v)) for (p, c), (n, s) in sums.items() for i, v in enumerate(s)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["part", "code", "i", "n", "s"])

    sums = distinct.mapInArrow(partial, "part int, code int, i int, n long, s decimal(38,0)").groupBy("part", "code", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = [b.copy() for b in books]
    for r in sums.collect():  # one row per component of an entry
        new[r["part"]][r["code"], r["i"]] = int(r["s"]) // r["n"]
    return new


def train(distinct: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    for _ in range(rounds if books else 0):
        books = next_codebooks(distinct, books)
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components in decimal by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def coded(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(part, piece, code, error) of every distinct piece."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for p, at, x in _by_part(b):
                code[at], error[at] = nearest_entries(x, books[p])
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("piece"), pa.array(code), pa.array(error)], names=["part", "piece", "code", "error"])

    return distinct.select("part", "piece").mapInArrow(assign, "part int, piece array<long>, code int, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per usable vector of ``vectors`` (vec_id, embedding, label).

    ``code`` has two hexadecimal digits for each part; ``error`` is the sum of final squared distances, ``label_error`` its sum over the rows of a label (nulls together, at most
    the largest long). Null, repeated and tied ids are rows like any other; without a usable vector the result is empty. The join back to the
    vectors has hot keys where many vectors are equal: it is a plain equi-join, whose large partitions Spark splits. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("two hexadecimal digits hold at most 256 entries")
    ints = integers(vectors, parts, scale)
    pieces = ints.select("row", "vec_id", "label", F.posexplode("parts").alias("part", "piece"))
    distinct = distinct_parts(pieces)
    books = train(distinct, first_codebooks(ints, entries), rounds)
    joined = pieces.join(materialize(coded(distinct, books), "coded"), ["part", "piece"])
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0")), "")
    whole = materialize(joined.groupBy("row", "vec_id", "label").agg(code.alias("code"), F.sum("error").alias("error")), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    labels = whole.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return whole.join(maybe_broadcast(labels), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _compress_sql() -> str:
    books = []
    for r in range(1, ROUNDS + 1):
        books.append(f"""
near{r} AS MATERIALIZED (SELECT p.part, p.id, arg_min(b.entry, (list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry FROM pieces p JOIN book{r - 1} b USING (part) GROUP BY p.part, p.id),
sum{r} AS (SELECT part, entry, i, sum(v) AS s, count(*) AS n FROM (SELECT n.part, n.entry, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS i FROM near{r} n JOIN pieces p USING (part, id)) GROUP BY ALL),
new{r} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM sum{r} GROUP BY ALL),
book{r} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM book{r - 1} b LEFT JOIN new{r} n USING (part, entry)),""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(x * {SCALE})::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
named AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM kept),
pieces AS MATERIALIZED (SELECT id, p AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM named, range({PARTS}) r(p)),
book0 AS (SELECT part, id AS entry, x FROM pieces WHERE id < {ENTRIES}),{"".join(books)}
far AS (SELECT p.part, p.id, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pieces p JOIN book{ROUNDS} b USING (part)),
best AS (SELECT part, id, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM far GROUP BY part, id),
whole AS (SELECT n.vec_id, n.label, string_agg(lpad(lower(hex(b.entry)), 2, '0'), '' ORDER BY b.part) AS code, sum(b.d)::BIGINT AS error FROM best b JOIN named n USING (id) GROUP BY n.id, n.vec_id, n.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256 FROM whole"""


COMPRESS_SQL = _compress_sql()
