"""One query per training-data operator, over its whole table, with production parameters; and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from senseloom.llm import ann, mixing, packing, quality, rules, secrets, sharding, simhash, spelling, toxicity, veccodes, warc, winnowing
from senseloom.llm.common import new_path, table
from senseloom.llm.labelled import fold


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 tokens, with a checksum of their ids: a null or empty text is the end id alone, repeated rows are packed each on its own, and an empty table gives no rows."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), emit="crc32")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and taken words of every document: null and blank texts have size 0, null is a source of its own, rows alike in id and text share a draw, and an empty table gives no rows."""
    planned = mixing.plan_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every text; a null text is scored like an empty one, a null id counts as not held out, repeated rows share a score, and an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text: a null text is empty, null ids come first, rows of one id are ordered by a hash of their text, and an empty table gives no rows."""
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: texts without words are linked with each other, null ids never name a component unless all its members have none, and an empty table gives no rows."""
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to archives and read back: a null html is an empty payload, ties of payloads go to the largest page_id, and an empty table gives no rows."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every query vector: null, zero and non-finite vectors and those of another length take no part, ties go to the smaller vec_id, and an empty table gives no rows."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: eight shards are written to the shared folder, and the result is read from there."""
    sharded = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    path = new_path(spark, "shards")
    sharding.write_shards(sharded, path)
    text = F.coalesce("text", F.lit(""))
    return sharding.read_shards(spark, path, sharded).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds in every text: null and empty texts have none, repeated rows repeat theirs, and an empty table gives no rows."""
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "secrets")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every text; a null text is scored like an empty one, a null id counts as not held out, repeated rows share a score, and an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, in which one run in 31 has lost a code point."""
    found = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(found.select(spelling.slip(F.col("doc_id"), F.col("word")).alias("word"))).select("word", "form", "root", "n", "n_near", "form_n")


def op12_veccodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight codes of sixteen entries each for every usable vector."""
    return veccodes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document and the cascade's verdict on it."""
    judged = rules.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *rules.MEASURES, "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_quality, op3_winnowing, op4_simhash, op5_packing, op6_warc, op7_neighbours, op8_sharding, op9_secrets, op10_toxicity, op11_spelling, op12_veccodes, op13_rules)}
ORACLES: dict[str, str] = {"op1_mixing": mixing.PLAN_SQL, "op6_warc": warc.ROUND_TRIP_SQL, "op11_spelling": spelling.VARIANTS_SQL, "op12_veccodes": veccodes.COMPRESS_SQL, "op13_rules": rules.SCORE_SQL}
