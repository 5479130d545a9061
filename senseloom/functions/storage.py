"""Tables in the shared folder of a cluster, to cut lineage between rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Whether a query's shuffle files are removed when it ends, rather than when the driver next collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="senseloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind: for rows that are read from a written table from then on."""
    before = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again. Its shuffle files go as soon as it is written."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with cleaning(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
    """Write ``df``, which is dealt by ``keys`` into ``buckets`` partitions, to the shared folder as a table in as many buckets and read it again: what groups, orders or joins it by ``keys`` moves no row."""
    table = f"{name}_{uuid.uuid4().hex}"
    with cleaning(df.sparkSession):
        df.write.option("compression", "zstd").bucketBy(buckets, *keys).option("path", f"{shared_folder(df.sparkSession)}/{table}").saveAsTable(table)
    return df.sparkSession.table(table)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as the cluster runs tasks at once, dealt by ``key``: work per row that is much larger than the row should not follow the split of a few files.

    A table of enough partitions stays where it is, so a large one is not shuffled.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)


def dealt(df: DataFrame, key: str, parts: int = 4) -> DataFrame:
    """``df`` dealt by ``key``, ``parts`` partitions for each that it has, and no fewer than the cluster runs tasks at once: for rows that become many, so that what belongs to a key stays together and a task's rows are few."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, parts * df.rdd.getNumPartitions()), key)
