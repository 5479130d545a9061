"""A stage table's shuffle files go when it is written, not when the driver next collects garbage."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from senseloom.functions import storage


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in folders for f in Path(d).rglob("shuffle_*")}


@pytest.mark.parametrize("write", [lambda df: storage.stored(df, "counts"), lambda df: storage.bucketed(df.repartition(4, "k"), "counts", 4, ["k"])])
def test_written_tables_leave_no_shuffle_files(spark, write):
    before, was = shuffle_files(spark), spark.conf.get(storage.CLEANED)
    rows = write(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    end = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(storage.CLEANED) == was
    assert sorted(map(tuple, rows.collect())) == [(k, 100) for k in range(100)]


def test_the_setting_returns_after_a_failure(spark):
    was = spark.conf.get(storage.CLEANED)
    with pytest.raises(Exception, match="no such row"):
        storage.stored(spark.range(1).select(F.raise_error(F.lit("no such row")).cast("long").alias("x")), "failing")
    assert spark.conf.get(storage.CLEANED) == was
