"""The inverted index from lemmas to occurrences, and samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from senseloom.functions.storage import stored
from senseloom.operators.text import is_valid, stem, vocabulary

SEED = 111
SAMPLE = 1000
BUCKETS = 64
#: Lemmas that differ from their token, as far as they are broadcast; hex digits of a file's hash by which frequent lemmas' files are counted.
CHANGED = 500_000
DIGITS = 2
#: A table of at most so many rows is broadcast.
SMALL = 200_000


def inverted_index(tokens: DataFrame, vocab: DataFrame, most: int = CHANGED) -> DataFrame:
    """Rows (lemma, file_id, pos, token, prev, next) of valid tokens that are full words: the next piece is not a half word.

    ``tokens`` carries each piece's neighbours, so the full-word test needs no window. ``vocab`` has all of their tokens; only those whose lemma is another word are looked up, broadcast after a
    count, so occurrences stay where their file is.
    """
    full = tokens.where(is_valid(F.col("token")) & ~F.coalesce(F.col("next").startswith("##"), F.lit(False)))
    changed = vocab.where("lemma <> token").select("token", "lemma")
    changed = F.broadcast(changed) if changed.limit(most + 1).count() <= most else changed
    return full.join(changed, "token", "left").select(F.coalesce("lemma", "token").alias("lemma"), "file_id", "pos", "token", "prev", "next")


def mark_first(index: DataFrame) -> DataFrame:
    """Add ``first``: whether an occurrence is its lemma's first in its file. Without a shuffle if the index is dealt by file_id."""
    return index.withColumn("first", F.row_number().over(Window.partitionBy("file_id", "lemma").orderBy("pos")) == 1)


def first_occurrences(index: DataFrame) -> DataFrame:
    """(lemma, file_id, pos): each lemma's first occurrence in each file, by a sum over hashed keys. Without a shuffle if the index is dealt by file_id."""
    return index.groupBy("lemma", "file_id").agg(F.min("pos").alias("pos"))


def positions(index: DataFrame) -> DataFrame:
    """The index with one row per lemma and file: an ordered array of positions. Without a shuffle if the index is dealt by file_id."""
    return index.groupBy("lemma", "file_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def write_index(index: DataFrame, table: str, buckets: int = BUCKETS, folder: str | None = None, batch: int = 0, files: DataFrame | None = None) -> None:
    """Store the index (with lemma and file_id) bucketed and sorted by lemma: a look-up of a lemma reads one bucket, and joins with other tables bucketed alike need no shuffle.

    A further call with a larger ``batch`` appends; the rows of a file in a later batch replace those of earlier ones when :func:`stored_index` reads the table. ``files`` (file_id) are the files of the batch: each
    leaves a row without a lemma, so one that has no occurrence in this batch replaces what it had, too. ``folder`` is the shared folder that the table lies in, by default the warehouse. Rows are dealt by bucket
    before they are written, so each bucket is one file of each batch.
    """
    spark = index.sparkSession
    if files is not None:
        index = index.unionByName(files.select("file_id").distinct(), allowMissingColumns=True)
    rows = index.withColumn("batch", F.lit(batch)).repartition(buckets, "lemma")
    writer = rows.write.bucketBy(buckets, "lemma").sortBy("lemma").mode("append")
    if folder and not spark.catalog.tableExists(table):
        writer = writer.option("path", f"{folder}/{table}")
    writer.saveAsTable(table)


def stored_index(spark: SparkSession, table: str, most: int = SMALL) -> DataFrame:
    """The stored index without the rows that a later batch of their file has replaced. With one batch that is the table as it is.

    The files of more than one batch are few beside the occurrences: they are broadcast after a count, else joined.
    """
    rows = spark.table(table)
    if rows.select("batch").distinct().count() <= 1:
        return rows.where("lemma IS NOT NULL").drop("batch")
    last = rows.groupBy("file_id").agg(F.max("batch").alias("_last"), F.min("batch").alias("_first")).where("_last > _first").select(F.col("file_id").alias("_file"), "_last")
    last = F.broadcast(last) if last.limit(most + 1).count() <= most else last
    return rows.where("lemma IS NOT NULL").join(last, (F.col("file_id") == F.col("_file")) & (F.col("batch") < F.col("_last")), "left_anti").drop("batch")


def look_up(index: DataFrame, lemmas: list[str]) -> DataFrame:
    """Occurrences of some lemmas; ValueError if one has none."""
    found = index.where(F.col("lemma").isin(*lemmas))
    missing = set(lemmas) - {r["lemma"] for r in found.select("lemma").distinct().collect()}
    if missing:
        raise ValueError(f"not in the index: {', '.join(sorted(missing))}")
    return found


def look_up_in(tokens: DataFrame, lemmas: list[str]) -> DataFrame:
    """:func:`look_up` for some lemmas without an index of all: one pass over ``tokens``, of which only those that can have such a lemma, and what tells it, are stored.

    Whether a token's lemma is its stem hangs on the stem being a token alone. So the lemmas, tokens with such a stem and the lemmas' own stems are enough.
    """
    token = F.col("token")
    near = stored(tokens.where(token.isin(*lemmas) | stem(token).isin(*lemmas) | token.isin(*[stem(F.lit(x)) for x in lemmas])), "near")
    return look_up(inverted_index(near, vocabulary(near)), lemmas)


def summary(index: DataFrame) -> DataFrame:
    """Matches and files of each lemma."""
    return index.groupBy("lemma").agg(F.count("*").alias("matches"), F.countDistinct("file_id").alias("files"))


def instances(index: DataFrame, n: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The first occurrence in each of at most ``n`` files per lemma, files chosen by a seeded hash; all files if ``n`` is negative, none if 0.

    Only the rows at the sample's edge are shuffled (:func:`edges_of`), so a very common lemma is no hot key. An index with ``first`` (:func:`mark_first`) is not grouped again. The index is read
    up to four times: it should be stored.
    """
    if "first" in index.columns:
        first = index.where("first").select("lemma", "file_id", "pos", "token", "prev", "next")
    else:
        first = index.groupBy("lemma", "file_id").agg(F.min(F.struct("pos", "token", "prev", "next")).alias("o")).select("lemma", "file_id", "o.*")
    return mark_sampled(first.withColumn("first", F.lit(True)), n, seed).where("sampled").drop("first", "sampled")


def mark_sampled(index: DataFrame, n: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Add ``sampled`` to an index with ``first``: whether an occurrence is among :func:`instances`. No row is moved, unless very many lemmas have more than ``n`` files."""
    if n <= 0:
        return index.withColumn("sampled", F.col("first") & F.lit(n < 0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("file_id").cast("string")))
    # A struct is compared field by field, null first, as the order of a window does.
    inside = F.col("_edge").isNull() | (F.struct(digest.alias("digest"), "file_id") <= F.col("_edge"))
    return index.join(_small(edges_of(index.where("first").select("lemma", "file_id"), digest, n)), "lemma", "left").withColumn("sampled", F.col("first") & inside).drop("_edge")


def edges_of(first: DataFrame, digest: Column, n: int) -> DataFrame:
    """(lemma, _edge): of each lemma of more than ``n`` rows the ``n``-th by ``digest`` and file, as a struct of both; a stored table.

    Rows are counted by the beginning of their digest, so only those that share the edge's beginning are ordered.
    """
    last = _small(stored(beginnings(first, n, digest), "beginnings"))
    at = first.join(last, "lemma").where(F.substring(digest, 1, DIGITS) == F.col("_last"))
    nth = F.row_number().over(Window.partitionBy("lemma").orderBy(digest, "file_id"))
    return stored(at.withColumn("_nth", nth).where(F.col("_nth") == n - F.col("_before")).select("lemma", F.struct(digest.alias("digest"), "file_id").alias("_edge")), "edges")


def _small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Broadcast hint after a count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def beginnings(first: DataFrame, n: int, digest: Column, most: int = SMALL) -> DataFrame:
    """(lemma, _last, _before): of each lemma of more than ``n`` rows the beginning of a digest with which there are ``n``, and how many rows come before it."""
    many = _small(stored(first.groupBy("lemma").count().where(F.col("count") > n).select("lemma"), "many"), most)
    counted = first.join(many, "lemma", "left_semi").groupBy("lemma", F.substring(digest, 1, DIGITS).alias("start")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("lemma").orderBy("start")) - F.col("rows")
    return counted.withColumn("before", before).where(F.col("before") < n).groupBy("lemma").agg(F.max("start").alias("_last"), F.max("before").alias("_before"))


def promising(first: DataFrame, digest: Column, n: int, most: int = SMALL) -> DataFrame:
    """The rows that can be among the ``n`` of least ``digest`` of their lemma: of a lemma of many rows those up to the beginning of a digest with which there are ``n``."""
    last = beginnings(first, n, digest, most).select("lemma", "_last")
    return first.join(last, "lemma", "left").where(F.col("_last").isNull() | (F.substring(digest, 1, DIGITS) <= F.col("_last"))).select(*first.columns)
