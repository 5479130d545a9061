"""Senses: votes of instances for communities, the sense inventory, and the sense of every occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from senseloom.functions.arrays import two_decimals
from senseloom.functions.storage import stored
from senseloom.operators.text import is_valid, pieces

QUERY_SIZE = 10
MIN_SECOND = 10
LISTED = 100
ASSIGN_TOP = 10
#: A list of at most so many lemmas is broadcast.
SMALL = 200_000


def votes(cleaned: DataFrame, communities: DataFrame, query_size: int = QUERY_SIZE) -> DataFrame:
    """(lemma, file_id, pos, community, votes, first_rank): how many of an instance's first substitutes are in a community, and the rank of the first.

    Substitutes in no community are ignored; instances without any vote do not appear.
    """
    first = cleaned.select("lemma", "file_id", "pos", F.slice("reps", 1, query_size).alias("reps"))
    return _votes(_met(_with_communities(first, communities)), ["lemma", "file_id", "pos"])


def _with_communities(rows: DataFrame, communities: DataFrame) -> DataFrame:
    """``rows`` (lemma, reps and others) and ``communities`` as rows of one substitute, dealt by lemma together: whatever groups by lemma and more moves no row again. A lemma's rows are bounded by the sample of its instances."""
    known = communities.select("lemma", F.array("token").alias("reps"), F.col("community").alias("_of"))
    both = rows.unionByName(known, allowMissingColumns=True)
    return both.where("lemma IS NOT NULL").repartition("lemma")  # what a join would add on one side only, so that two readers share the shuffle


def _met(both: DataFrame) -> DataFrame:
    """Of the rows of :func:`_with_communities` one row for each substitute that is in a community, with rank (from 0), token and community."""
    each = both.select("*", F.posexplode("reps").alias("rank", "token"))
    return each.withColumn("community", F.max("_of").over(Window.partitionBy("lemma", "token"))).where("_of IS NULL AND community IS NOT NULL").drop("_of")


def _votes(met: DataFrame, keys: list[str]) -> DataFrame:
    return met.groupBy(*keys, "community").agg(F.count("*").alias("votes"), F.min((F.col("rank") + 1).cast("long")).alias("first_rank"))


def argmax(votes: DataFrame, keys: tuple[str, ...] = ("lemma", "file_id", "pos")) -> DataFrame:
    """The community with most votes of each instance, of equal ones that met first in rank order: (lemma, file_id, pos, community, votes), or of each row named by ``keys``."""
    best = F.max_by(F.struct("community", "votes"), F.struct("votes", (-F.col("first_rank")).alias("r"), (-F.col("community")).alias("c")))
    return votes.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.community", "b.votes")


def soft_labels(votes: DataFrame) -> DataFrame:
    """Map of community to votes of each instance."""
    return votes.groupBy("lemma", "file_id", "pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("community", "votes")))).alias("labels"))


def hard_labels(best: DataFrame) -> DataFrame:
    """Communities numbered by how many instances chose them: (lemma, file_id, pos, label). No row is moved if ``best`` lies by lemma."""
    sized = best.withColumn("_n", F.count("*").over(Window.partitionBy("lemma", "community")))
    number = F.dense_rank().over(Window.partitionBy("lemma").orderBy(F.desc("_n"), "community"))
    return sized.select("lemma", "file_id", "pos", (number.cast("long") - 1).alias("label"))


def inventory(cleaned: DataFrame, communities: DataFrame, min_second: int = MIN_SECOND, listed: int = LISTED, query_size: int = QUERY_SIZE) -> DataFrame:
    """The senses of every lemma: (lemma, sense_id, rank, token, cnt).

    Communities are ordered by instances that chose them, then by nodes, then by number. A community stays if its second most popular token
    occurs in more than ``min_second`` instances; senses are numbered after that. Tokens go by popularity, then name; ``listed`` are kept.
    ``cleaned`` may have ``times``, the instances that a row stands for, and ``communities`` may have ``cnt``, the tokens' popularity, which is counted else. Instances of a lemma with the same substitutes vote alike, so they are one row; rows are dealt by lemma once.
    """
    times = F.col("times") if "times" in cleaned.columns else F.lit(1).cast("long")
    both = _with_communities(cleaned.select("lemma", "reps", times.alias("times")), communities)
    met = _met(both.groupBy("lemma", "reps", "_of").agg(F.sum("times").alias("times")))
    within = Window.partitionBy("lemma", "community")
    counted = communities.select("lemma", "community", "token", "cnt") if "cnt" in communities.columns else met.groupBy("lemma", "community", "token").agg(F.sum("times").alias("cnt"))
    ranked = counted.withColumn("rank", F.row_number().over(within.orderBy(F.desc("cnt"), "token")).cast("long"))
    shape = ranked.withColumn("size", F.count("*").over(within)).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("cnt"))).over(within))
    lists = ("lemma", "reps", "times")
    chosen = argmax(_votes(met.where(F.col("rank") < query_size), [*lists]), lists).groupBy("lemma", "community").agg(F.sum("times").alias("won"))
    order = Window.partitionBy("lemma").orderBy(F.desc(F.coalesce("won", F.lit(0))), F.desc("size"), "community")
    kept = shape.where((F.col("second") > min_second) & (F.col("rank") <= listed)).join(chosen, ["lemma", "community"], "left")
    return kept.withColumn("sense_id", F.dense_rank().over(order).cast("long") - 1).select("lemma", "sense_id", "rank", "token", "cnt")


def sense_sets(inventory: DataFrame) -> DataFrame:
    """(lemma, sense_id, tokens): a sense's tokens as an array by rank."""
    items = F.array_sort(F.collect_list(F.struct("rank", "token")))
    return inventory.groupBy("lemma", "sense_id").agg(F.transform(items, lambda x: x["token"]).alias("tokens"))


def assign(cleaned: DataFrame, inventory: DataFrame, top: int = ASSIGN_TOP, keys: tuple[str, ...] = ("lemma", "file_id", "pos")) -> DataFrame:
    """The sense of each occurrence: (lemma, file_id, pos, sense_id, shared, total, score), or of each row named by ``keys``.

    An occurrence's first ``top`` substitutes (its own lemma may be among them) are compared with each sense of its lemma by Jaccard similarity; the best wins,
    of equal ones the smallest number, and only a score above 0 counts. The lemma itself must be a valid token. Rows and senses are dealt by lemma together and sorted, a lemma's senses first, so
    rows stream by and meet their senses by equal tokens alone: no row is compared with a list.
    """
    known = sense_sets(inventory).select("lemma", "sense_id", F.col("tokens").alias("reps"))
    rows = cleaned.where(is_valid(F.col("lemma"))).select(*keys, F.slice("reps", 1, top).alias("reps"))
    both = rows.unionByName(known, allowMissingColumns=True).repartition("lemma").sortWithinPartitions("lemma", F.col("sense_id").asc_nulls_last())
    counted = StructType([rows.schema[k] for k in keys] + [StructField(c, LongType()) for c in ("sense_id", "shared", "total")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last lemma's senses, whose rows may go on
        for b in batches:
            of = pc.is_valid(b.column("sense_id"))
            senses, asked = (pa.Table.from_batches([b.filter(x)]) for x in (of, pc.invert(of)))
            senses = pa.concat_tables([held, senses]) if held else senses
            if asked.num_rows and senses.num_rows:
                yield from _best_senses(asked, senses, list(keys)).to_batches()
            held = senses.filter(pc.equal(senses.column("lemma"), b.column("lemma")[-1])) if b.num_rows else senses

    return both.mapInArrow(each, counted).withColumn("score", F.col("shared") / F.col("total"))


def _best_senses(asked: pa.Table, senses: pa.Table, keys: list[str]) -> pa.Table:
    """The best sense (sense_id, shared, total) of each row of ``asked`` that shares a token with one of its lemma's."""

    def both(column: str, values=lambda x: x) -> tuple[np.ndarray, np.ndarray, int]:
        one, other = (values(t.column(column).combine_chunks()) for t in (senses, asked))
        held = pa.concat_arrays([one, other]).dictionary_encode()
        codes = held.indices.to_numpy().astype(np.int64)
        return codes[: len(one)], codes[len(one) :], len(held.dictionary)

    of_sense, of_row, _ = both("lemma")
    sense_token, row_token, n = both("reps", lambda x: x.flatten())
    sizes, lengths = (pc.list_value_length(t.column("reps").combine_chunks()).to_numpy().astype(np.int64) for t in (senses, asked))
    key, sense = np.repeat(of_sense, sizes) * n + sense_token, np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(key, kind="stable")
    key, sense = key[order], sense[order]
    wanted, row = np.repeat(of_row, lengths) * n + row_token, np.repeat(np.arange(len(lengths)), lengths)
    first = np.searchsorted(key, wanted)
    met = np.searchsorted(key, wanted, "right") - first  # a token may be in several senses
    at = np.repeat(first - np.cumsum(met) + met, met) + np.arange(met.sum())
    pair, shared = np.unique(np.repeat(row, met) * len(sizes) + sense[at], return_counts=True)
    row, sense = pair // len(sizes), pair % len(sizes)
    total, number = lengths[row] + sizes[sense] - shared, senses.column("sense_id").to_numpy()[sense]
    order = np.lexsort((number, -(shared / total), row))
    best = order[np.r_[True, np.diff(row[order]) > 0]] if len(order) else order
    out = asked.select(keys).take(pa.array(row[best]))
    for name, column in (("sense_id", number), ("shared", shared), ("total", total)):
        out = out.append_column(name, pa.array(column[best].astype(np.int64)))
    return out


def assign_by_token(index: DataFrame, by_token: DataFrame, inventory: DataFrame, top: int = ASSIGN_TOP, most: int = SMALL) -> DataFrame:
    """:func:`assign` for all occurrences of ``index``: a sense is found once for each context and token (:func:`substitutes.by_token`), and occurrences look theirs up.

    So substitutes do not travel with occurrences. Lemmas without senses are left out before an occurrence is moved, if the list of those with some can be broadcast. A token has one lemma, which does not travel
    with occurrences either, nor do those at a text's ends, which have no context.
    """
    unit = ["prev", "next", "token"]
    known = stored(inventory.select("lemma").distinct(), "lemmas")
    held = index.where("prev IS NOT NULL AND next IS NOT NULL").select("file_id", "pos", *unit, "lemma")
    if known.limit(most + 1).count() <= most:
        held, by_token = (x.join(F.broadcast(known), "lemma", "left_semi") for x in (held, by_token))
    return held.drop("lemma").join(assign(by_token, inventory, top, (*unit, "lemma")), unit).select("lemma", "file_id", "pos", "sense_id", "shared", "total", "score")


def aligned(tokens: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per position of the corpus: (file_id, pos, sense_id), -1 where there is none."""
    known = assigned.select("file_id", "pos", "sense_id")
    return tokens.select("file_id", "pos").join(known, ["file_id", "pos"], "left").select("file_id", "pos", F.coalesce("sense_id", F.lit(-1).cast("long")).alias("sense_id"))


def positions_by_sense(assigned: DataFrame) -> DataFrame:
    """(lemma, sense_id, file_id, found): occurrences of a sense in a file as pos,score by position, scores rounded to two decimals."""
    items = F.array_sort(F.collect_list(F.struct("pos", "score")))
    line = F.array_join(F.transform(items, lambda x: F.concat(x["pos"].cast("string"), F.lit(","), two_decimals(x["score"]))), " ")
    return assigned.groupBy("lemma", "sense_id", "file_id").agg(line.alias("found"))


def retrieve(assigned: DataFrame, wanted: DataFrame) -> DataFrame:
    """Occurrences of the given senses (lemma, sense_id)."""
    return assigned.join(wanted.select("lemma", "sense_id").distinct(), ["lemma", "sense_id"], "left_semi")


def histogram(assigned: DataFrame, inventory: DataFrame, shown: int = 4) -> DataFrame:
    """Occurrences per sense, with a label of the lemma and its first tokens; senses without any count 0."""
    labels = sense_sets(inventory).select("lemma", "sense_id", F.array_join(F.concat(F.array("lemma"), F.slice("tokens", 1, shown)), " ").alias("label"))
    counted = assigned.groupBy("lemma", "sense_id").agg(F.count("*").alias("n"))
    return labels.join(counted, ["lemma", "sense_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def examples(assigned: DataFrame, docs: DataFrame, n: int = 5, reach: int = 8) -> DataFrame:
    """The first ``n`` occurrences of each sense by file and position, with the pieces up to ``reach`` places around: (lemma, sense_id, nth, file_id, pos, example). ``docs`` has doc_id and text.

    Occurrences are chosen before texts are read, so a text is cut for chosen occurrences alone.
    """
    order = Window.partitionBy("lemma", "sense_id").orderBy("file_id", "pos")
    chosen = assigned.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= n).select("lemma", "sense_id", "nth", "file_id", "pos")
    wanted = chosen.groupBy("file_id").agg(F.collect_list(F.struct("lemma", "sense_id", "nth", "pos")).alias("found"))
    stream = docs.join(wanted, F.col("doc_id") == F.col("file_id")).select("file_id", "found", pieces(F.col("text")).alias("s"))
    start = lambda x: F.greatest(x["pos"] - reach, F.lit(0)).cast("int")
    cut = F.transform("found", lambda x: x.withField("example", F.array_join(F.slice("s", start(x) + 1, (x["pos"] + reach + 1).cast("int") - start(x)), " ")))
    return stream.select("file_id", F.explode(cut).alias("x")).select("x.lemma", "x.sense_id", "x.nth", "file_id", "x.pos", "x.example")


def community_descriptions(best: DataFrame, cleaned: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent tokens among a community's own instances: (lemma, community, rank, token, cnt)."""
    own = best.join(cleaned.select("lemma", "file_id", "pos", "reps"), ["lemma", "file_id", "pos"]).select("lemma", "community", F.explode("reps").alias("token"))
    counted = own.groupBy("lemma", "community", "token").agg(F.count("*").alias("cnt"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lemma", "community").orderBy(F.desc("cnt"), "token")).cast("long"))
    return ranked.where(F.col("rank") <= n)
