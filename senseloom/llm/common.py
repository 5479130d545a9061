"""What several operators share: the shared work folder, tables that cut lineage, and batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; the same pattern works in Spark, Python and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many rows may be broadcast (checked with a count before each use).
BROADCAST_ROWS = 200_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="senseloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a narrow table only if it has at most ``most`` rows; beyond that the join shuffles and AQE splits hot keys."""
    n = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of ``column`` in each part have about ``most_bytes`` (one longer text stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def parts_of(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A text in parts of at most ``most`` characters, cut at spaces where there are any."""
    at = 0
    while len(text) - at > most:
        end = text.rfind(" ", at + 1, at + most)
        end = end if end > 0 else at + most
        yield text[at:end]
        at = end
    yield text[at:]


def batched_parts(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of all texts in batches of about ``most`` characters, with the place of each part's text."""
    of, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for part in parts_of(text, most):
            if parts and held + len(part) > most:
                yield of, parts
                of, parts, held = [], [], 0
            of.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield of, parts
