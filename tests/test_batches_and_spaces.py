"""Files that a later batch leaves empty, and sentences between spaces of every kind."""

import uuid

import duckdb
from pyspark.sql import functions as F

from senseloom.operators import index, text


def test_a_batch_replaces_files_that_it_leaves_empty(spark):
    table = f"index_{uuid.uuid4().hex}"
    first = spark.createDataFrame([("a", 3, 1), ("b", 3, 5), ("a", 6, 2), ("a", 4, 1)], "lemma string, file_id long, pos long")
    index.write_index(first, table)
    index.write_index(first.where("file_id % 3 = 0 AND pos % 2 = 0"), table, batch=1, files=spark.createDataFrame([(3,), (6,)], "file_id long"))
    assert sorted(map(tuple, index.stored_index(spark, table).collect())) == [("a", 4, 1), ("a", 6, 2)]


def test_sentences_end_at_spaces_of_every_kind(spark):
    spaces = [" ", *map(chr, (0xA0, 0x1680, 0x2000, 0x2003, 0x200A, 0x202F, 0x205F, 0x3000))]
    lines = [f"{s}One.  Two!{s} {s}" for s in spaces] + ["  　", "\tOne. \t", "​One.​"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r["s"] for r in frame.select(text.split_sentences(F.col("line")).alias("s")).collect()]
    cut = r"SELECT list_filter(list_transform(string_split(regexp_replace(?, '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    assert got == [duckdb.execute(cut, [x]).fetchone()[0] for x in lines]
