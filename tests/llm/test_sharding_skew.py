from collections import Counter

from pyspark.sql import functions as F

from senseloom.llm import sharding


def test_rows_alike_are_spread_over_buckets(spark, monkeypatch):
    seen = []
    write = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, name: (seen.append((name, out := write(df, name))), out)[1])
    alike = spark.range(2500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    one_id = spark.range(2500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = alike.union(one_id).union(spark.range(2500).select("id", F.lit(None).cast("string")))
    rows = sharding.shuffle_into_shards(docs, 3, bucket_bytes=20_000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(map(tuple, docs.collect()))
    assert sorted((r["slot"], r["shard"]) for r in rows) == [(i // 3, i % 3) for i in range(7500)]
    counts = [r["_n"] for name, frame in seen if name == "buckets" for r in frame.collect()]
    assert max(counts) < 3 * sum(counts) / len(counts)
    again = sharding.shuffle_into_shards(docs.repartition(7), 3, bucket_bytes=20_000).collect()
    assert Counter(rows) == Counter(again)


def test_written_shards_come_back(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("_row"), F.lit(2).alias("_bucket"))
    sharded = sharding.shuffle_into_shards(docs, 4, bucket_bytes=4096)
    sharding.write_shards(sharded, f"{tmp_path}/shards")
    back = sharding.read_shards(spark, f"{tmp_path}/shards", sharded)
    assert back.columns == ["doc_id", "text", "_row", "_bucket", "shard", "slot"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sharded.collect()))


def test_the_shuffle_made_anew(spark):
    """The same places by hand: buckets, order in a bucket, seeded permutation and equal stretches."""
    import numpy as np

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    hashed = docs.withColumn("a", F.xxhash64(F.lit(8), F.lit("00"), "doc_id", "text"))
    total = sum(len(r["text"]) + 64 for r in docs.collect())
    buckets = -(-total // 2048)
    placed = hashed.select("doc_id", "text", F.pmod(F.xxhash64("a", F.lit(0).cast("long")), F.lit(buckets)).alias("b")).collect()
    at, start = {}, 0
    for b in range(buckets):
        ids = sorted(r["doc_id"] for r in placed if r["b"] == b)
        for i, p in zip(ids, np.random.default_rng([8, b]).permutation(len(ids)), strict=True):
            at[i] = start + p
        start += len(ids)
    found = {r["doc_id"]: r["shard"] * 100 + r["slot"] for r in sharding.shuffle_into_shards(docs, 3, bucket_bytes=2048).collect()}
    assert found == at
