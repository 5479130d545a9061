"""Sharding by a two-pass external shuffle.

First pass: a seeded hash of all columns scatters records uniformly into buckets that fit in memory; of many records alike, each is scattered by its number. Second pass: each
bucket is put in a fixed order, shuffled by Fisher-Yates with a seed of its own, and its records take the places after those of the buckets before it. The shards are equal
stretches of those places: counts differ by one at most, slots have no gaps, and a bucket is written to one shard, or two at a border, so files stay as large as buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from senseloom.llm.common import materialize, maybe_broadcast

SEED = 8
#: Bytes of text in a bucket, and the most buckets: beyond 16 TB buckets grow with the table, to 100 MB at 100 TB.
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 20
#: Tasks of the second pass; with more buckets than that, a task shuffles several, one after another.
MOST_TASKS = 20_000
#: Rows alike that are made anew in one task.
CHUNK_ROWS = 1000


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to every record, in random order.

    ``docs`` has doc_id, text and any other columns but maps; all are kept. The order depends on the rows and the seed alone. Null and empty texts, records
    without an id and repeated ids are shuffled like others. Rows alike in all columns are
    interchangeable: where they fill a good part of a bucket, one of them stands for all, and its numbered copies are scattered. An empty table gives an empty
    one. Columns named ``shard`` or ``slot`` are replaced; other names cannot clash.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    rows_in = total["n"]
    buckets = int(max(1, min(MOST_BUCKETS, -(-(total["bytes"] + 64 * rows_in) // bucket_bytes))))
    # The record travels as one struct, so that no name of its columns meets one of ours.
    record = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row")
    columns = [F.col(f"`{c}`") for c in kept]
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("_size")
    hashed = docs.select(record, F.xxhash64(F.lit(seed), nulls, *columns).alias("_a"), F.xxhash64(F.lit(seed + 1), nulls, *columns).alias("_b"), size)
    many = hashed.groupBy("_a", "_b").agg(F.count("*").alias("_many"), (F.max("_size") + 64).alias("_size")).where((F.col("_many") > 1) & (F.col("_many") * F.col("_size") > bucket_bytes // 8))
    many = materialize(many.select("_a", "_b", "_many"), "alike")
    first = F.lit(0).cast("long").alias("_nth")
    rows = hashed.select("_row", "_a", first)
    if held := many.count():
        small = maybe_broadcast(many, held)
        # One of the rows alike travels, and is made anew in as many tasks as it has chunks.
        one = hashed.join(small, ["_a", "_b"]).groupBy("_a", "_b").agg(F.first("_row").alias("_row"), F.first("_many").alias("_many"))
        chunks = one.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1, F.lit(CHUNK_ROWS).cast("long")))).repartition("_a", "_from")
        made = chunks.withColumn("_nth", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK_ROWS, "_many") - 1)))
        rows = hashed.join(small, ["_a", "_b"], "left_anti").select("_row", "_a", first).unionByName(made.select("_row", "_a", "_nth"))
    scattered = rows.select("_row", F.pmod(F.xxhash64("_a", "_nth"), F.lit(buckets)).cast("int").alias("_bucket"))
    counts = materialize(scattered.groupBy("_bucket").agg(F.count("*").alias("_n")), "buckets")
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = scattered.join(maybe_broadcast(starts, buckets, MOST_BUCKETS), "_bucket")
    ends = np.array([-(-i * rows_in // shards) for i in range(1, shards + 1)])  # the place after each shard's last

    def shuffle(bucket: pa.Table) -> pa.Table:
        start, number = bucket.column("_start")[0].as_py(), bucket.column("_bucket")[0].as_py()
        row = bucket.column("_row").combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        key = pa.table([pc.struct_field(row, kept.index(c)) for c in ("doc_id", "text")], names=["doc_id", "text"])
        at = np.empty(len(row), np.int64)
        at[pc.sort_indices(key, [("doc_id", "ascending"), ("text", "ascending")]).to_numpy()] = np.random.default_rng([seed, number]).permutation(len(row)) + start  # Fisher-Yates
        shard = np.searchsorted(ends, at, "right")
        return pa.table([row, pa.array(shard.astype(np.int32)), pa.array(at - np.r_[0, ends][shard])], names=["_row", "shard", "slot"])

    schema = StructType([hashed.schema["_row"], StructField("shard", IntegerType()), StructField("slot", LongType())])
    dealt = placed.repartitionById(buckets, "_bucket") if buckets <= MOST_TASKS else placed.repartition(MOST_TASKS, "_bucket")
    return dealt.groupBy("_bucket").applyInArrow(shuffle, schema).select("_row.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shards as folders of Parquet files, one file for each bucket and shard; ``slot`` keeps the order of a shard's records."""
    sharded.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read what :func:`write_shards` wrote, with the columns of ``like``; a filter on ``shard`` reads that shard's folder alone."""
    return spark.read.schema(like.schema).parquet(path).select(*(F.col(f"`{c}`") for c in like.columns))
