"""Vectors: weighting, cosines, neighbours, centroids, clustering and merging of senses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from senseloom.functions.arrays import cosine
from senseloom.functions.storage import stored
from senseloom.functions.streams import coded, whole_keys

MAX_CLUSTERS = 7
MIN_SIZE = 2
CUTOFF = 0.9
TILE = 65_536
#: Centroids that may be broadcast.
MOST_CLUSTERS = 50_000


def tfidf(cleaned: DataFrame) -> DataFrame:
    """Weight of each substitute of a lemma in a binary bag: (lemma, token, df, n, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    total = cleaned.groupBy("lemma").agg(F.count("*").alias("n"))
    seen = cleaned.select("lemma", F.explode("reps").alias("token")).groupBy("lemma", "token").agg(F.count("*").alias("df"))
    return seen.join(total, "lemma").withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def centroids(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector of each key: (key, n, centroid). Components are averaged by place, so no vector is gathered whole."""
    parts = vectors.select(key, F.posexplode(as_double(F.col(vector))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def centroid_cosines(centroids: DataFrame, key: str) -> DataFrame:
    """Cosine of each pair of centroids, (a, b, cosine) with a < b: one row per pair of clusters, whose number is small."""
    a, b = (centroids.select(F.col(key).alias(x), F.col("centroid").alias(f"v{x}")) for x in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tile: int = TILE) -> DataFrame:
    """The ``k`` nearest rows of each query by cosine, exactly: (query_id, vec_id, cosine, rank). ``vectors`` has vec_id and embedding.

    Queries and rows meet in tiles of bounded size; each tile returns its ``k`` best for each query. Ties go to the smaller vec_id.
    """
    n, m = vectors.count(), vectors.where(is_query).count()
    rows_in, queries_in = max(4, -(-n // tile)), max(1, -(-m // tile))
    block = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    held = vectors.select("vec_id", as_double(F.col("embedding")).alias("v"), block(rows_in).alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(queries_in - 1))))
    asked = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), as_double(F.col("embedding")).alias("q"), block(queries_in).alias("b")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(rows_in - 1))))

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [[], [], []]
        if asked.num_rows and held.num_rows:
            held = held.sort_by("vec_id")
            ids, rows = held.column("vec_id").to_numpy(), unit(held.column("v"))
            queries, names = unit(asked.column("q")), asked.column("query_id").to_numpy()
            for a in range(0, len(names), 256):
                for who, score in zip(names[a : a + 256], queries[a : a + 256] @ rows.T, strict=True):
                    score[ids == who] = -np.inf
                    top = np.argsort(-score, kind="stable")[:k]
                    top = top[score[top] > -np.inf]
                    for x, y in zip(out, (np.full(len(top), who), ids[top], score[top]), strict=True):
                        x.append(y)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t)) for x, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "cosine"])

    met = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInArrow(meet, "query_id long, vec_id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")).cast("long")
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_small_clusters(vectors: DataFrame, key: str, vector: str, least: int = MIN_SIZE) -> DataFrame:
    """Map each cluster to its new number: (cluster, size, merged). Clusters under ``least`` rows join the nearest larger one by cosine of centroids.

    New numbers follow the old ones of the clusters that stay, from 0; if none is large enough, nothing is merged.
    """
    found = centroids(vectors, key, vector).withColumnRenamed(key, "cluster")
    big = found.where(F.col("n") >= least).select(F.col("cluster").alias("home"), F.col("centroid").alias("home_v"))
    # Clusters are few, but their number is not known: the large ones are broadcast after a count.
    small = found.where(F.col("n") < least)
    pairs = small.crossJoin(F.broadcast(big) if big.limit(MOST_CLUSTERS + 1).count() <= MOST_CLUSTERS else big).select("cluster", "home", cosine(F.col("centroid"), F.col("home_v")).alias("c"))
    nearest = pairs.groupBy("cluster").agg(F.max_by("home", F.struct("c", (-F.col("home")).alias("h"))).alias("home"))
    homes = found.join(nearest, "cluster", "left").select("cluster", F.col("n").alias("size"), F.coalesce("home", "cluster").alias("home"))
    return homes.select("cluster", "size", (F.dense_rank().over(Window.orderBy("home")) - 1).cast("long").alias("merged"))


def average_linkage(x: np.ndarray, most: int = MAX_CLUSTERS) -> np.ndarray:
    """Average-linkage clusters of rows by cosine distance, cut at the height that leaves at most min(most, n - 1) of them.

    Equal rows are one cluster from the start. Each cluster's nearest is kept, so a merge looks at the whole matrix only for those that were nearest to what has merged; of equal distances the first counts.
    """
    n = len(x)
    if n < 2:
        return np.zeros(n, int)
    seen: dict[bytes, int] = {}
    of = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in x])
    x, size = x[np.unique(of, return_index=True)[1]], np.bincount(of).astype(float)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    near = d.argmin(1)
    least = d[np.arange(len(d)), near]
    heights, merges = [], []
    for _ in range(len(d) - 1):
        i, j = sorted((one := least.argmin(), near[one]))
        heights.append(d[i, j])
        merges.append((i, j))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = row, row, np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        closer = (row < least) | ((row == least) & (i < near))
        near[closer], least[closer] = i, row[closer]
        stale = np.flatnonzero(((near == i) & ~closer) | (near == j))
        stale = np.append(stale, i)
        near[stale] = d[stale].argmin(1)
        least[stale] = d[stale, near[stale]]
        least[j] = np.inf
    most = min(most, n - 1)
    cut = heights[-most] if most <= len(heights) else 0.0  # equal rows merge at 0
    label = np.arange(len(d))
    for i, j in merges[: max((k + 1 for k, h in enumerate(heights) if h <= cut + 1e-12), default=0)]:
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1][of]


def hac_senses(cleaned: DataFrame, most: int = MAX_CLUSTERS) -> DataFrame:
    """Agglomerative clusters of each lemma's instances over TF-IDF bags of substitutes: (lemma, file_id, pos, cluster), largest first.

    A lemma's instances are bounded by the sample. They are dealt by lemma and stream by in order of file and position, many lemmas in a step.
    """

    def clusters(place: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the instances of one lemma, whose ``n`` substitutes follow each other in ``place``."""
        names, place = np.unique(place, return_inverse=True)
        bag = np.zeros((len(n), len(names)))
        bag[np.repeat(np.arange(len(n)), n), place] = 1
        label = average_linkage(bag * (np.log((1 + len(bag)) / (1 + bag.sum(0))) + 1), most)
        return np.argsort(np.argsort(-np.bincount(label), kind="stable"))[label]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, "lemma"):
            reps = t.column("reps").combine_chunks()
            n, place, lemma = pc.list_value_length(reps).to_numpy(), coded(reps.flatten())[0], coded(t.column("lemma"))[0]
            starts, ends = np.r_[np.flatnonzero(np.r_[True, lemma[1:] != lemma[:-1]]), len(t)], np.r_[0, np.cumsum(n)]
            found = [clusters(place[ends[a] : ends[b]], n[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield from t.drop_columns("reps").append_column("cluster", pa.array(np.concatenate(found).astype(np.int64))).to_batches()

    rows = cleaned.select("lemma", "file_id", "pos", "reps").repartition("lemma").sortWithinPartitions("lemma", "file_id", "pos")
    return rows.mapInArrow(each, "lemma string, file_id long, pos long, cluster long")


def merge_close(names: list[str], vectors: np.ndarray, cutoff: float = CUTOFF) -> tuple[list[str], np.ndarray, list[str]]:
    """While two vectors' cosine exceeds ``cutoff``, put the closest pair's mean in place of the first; also each name's final one."""
    home = list(range(len(names)))
    alive = np.ones(len(names), bool)
    v = vectors.astype(float).copy()
    while alive.sum() > 1:
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        c = np.triu(unit @ unit.T, 1)
        c[~alive] = c[:, ~alive] = 0
        i, j = np.unravel_index(np.argmax(c), c.shape)
        if c[i, j] <= cutoff:
            break
        v[i] = (v[i] + v[j]) / 2
        alive[j] = False
        home = [i if h == j else h for h in home]
    kept = np.flatnonzero(alive)
    return [names[i] for i in kept], v[kept], [names[h] for h in home]


def merge_close_senses(embeddings: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Merge close senses of each word: (word, key, merged_key). ``embeddings`` has word, key and vector; a word has few senses."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        _, _, home = merge_close(group["key"].to_list(), np.stack(group["vector"].to_list()), cutoff)
        return pd.DataFrame({"word": group["word"], "key": group["key"], "merged_key": home})

    return embeddings.select("word", "key", "vector").groupBy("word").applyInPandas(one, "word string, key string, merged_key string")


def shrinkage(before: DataFrame, after: DataFrame) -> DataFrame:
    """Numbers of senses before and after, of all words and of words that had several, and the relative drop."""
    count = lambda df, name: df.groupBy("word").agg(F.count("*").alias(name))
    joined = count(before, "b").join(count(after, "a"), "word", "left").withColumn("a", F.coalesce("a", F.lit(0)))
    many = lambda c: F.coalesce(F.sum(F.when(F.col("b") > 1, F.col(c))), F.lit(0)).alias(f"{c}_many")
    sums = joined.agg(F.sum("b").alias("before"), F.sum("a").alias("after"), many("b"), many("a"))
    return sums.select("before", "after", F.col("b_many").alias("before_many"), F.col("a_many").alias("after_many"), ((F.col("before") - F.col("after")) / F.col("before")).alias("shrunk"), ((F.col("b_many") - F.col("a_many")) / F.col("b_many")).alias("shrunk_many"))


def sense_keys(keys: DataFrame) -> DataFrame:
    """Parse keys word or word_k: (word, key, sense, rank); numbered senses by number, the bare word last (100); names that start with _ are left out."""
    word = F.split_part("key", F.lit("_"), F.lit(1))
    parsed = keys.where(~F.col("key").startswith("_")).select(word.alias("word"), "key", F.coalesce(F.expr("try_cast(nullif(split_part(key, '_', 2), '') AS BIGINT)"), F.lit(100).cast("long")).alias("sense"))
    return parsed.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("sense", "key")).cast("long"))


def word2vec(sentences: DataFrame, size: int = 100, window: int = 5, min_count: int = 5, epochs: int = 10, seed: int = 111, parts: int = 16) -> DataFrame:
    """Skip-gram vectors of sense-tagged words: (key, word, sense, vector). ``sentences`` has an array of words.

    Sentences are learnt from in ``parts`` partitions, dealt by a hash of their words; the partitions' vectors are averaged after each epoch, so ``parts`` is a parameter of the result.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = stored(sentences.select("words"), "sentences").repartition(parts, F.xxhash64("words"))
    model = Word2Vec(numPartitions=parts, vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, inputCol="words", outputCol="v").fit(words)
    rows = model.getVectors().select(F.col("word").alias("key"), vector_to_array("vector").alias("vector"))
    return rows.select("key", F.split_part("key", F.lit("_"), F.lit(1)).alias("word"), F.expr("try_cast(nullif(split_part(key, '_', 2), '') AS BIGINT)").alias("sense"), "vector")


def save_vectors(vectors: DataFrame, path: str, files: int = 16) -> None:
    """Store vectors (key, vector, ..), dealt into ranges of keys and sorted, so that a look-up of a key skips the other files by their statistics."""
    vectors.repartitionByRange(files, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Stored vectors, or those of some keys; KeyError if one of them is missing."""
    rows = spark.read.parquet(path)
    if keys is None:
        return rows
    found = rows.where(F.col("key").isin(*keys))
    missing = set(keys) - {r["key"] for r in found.select("key").collect()}
    if missing:
        raise KeyError(f"no vector of {', '.join(sorted(missing))}")
    return found


def tag_sentences(tokens: DataFrame, paragraphs: DataFrame, aligned: DataFrame) -> DataFrame:
    """Sense-tagged words of each paragraph: (file_id, paragraph, words). A piece with a sense is written piece_sense; ## pieces are glued to the one before.

    One paragraph is one group; words are glued by a fold over its pieces. ``aligned`` (file_id, pos, sense_id) may leave out pieces without a sense.
    """
    from senseloom.operators.text import locate

    joined = tokens.select("file_id", "pos", "token").join(aligned.select("file_id", "pos", "sense_id"), ["file_id", "pos"], "left")
    named = joined.select("file_id", "pos", F.when(F.col("sense_id") >= 0, F.concat("token", F.lit("_"), F.col("sense_id").cast("string"))).otherwise(F.col("token")).alias("piece"))
    grouped = locate(named, paragraphs).groupBy("file_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    line = F.array_join(F.transform("p", lambda x: x["piece"]), " ")
    return grouped.select("file_id", "paragraph", F.split(F.replace(line, F.lit(" ##"), F.lit("")), " ").alias("words"))
