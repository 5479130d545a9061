"""Queries over vectors, labels and gold partitions.

The embeddings stand for sense vectors: vector ``i`` is sense ``i % 3`` of word ``i // 3``, and its label is its topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from senseloom.functions.arrays import norm
from senseloom.operators import cbow, evaluation, vectors
from senseloom.operators import senses as sense_ops
from senseloom.plans import corpus
from senseloom.plans.sql import STOPS
from senseloom.plans.sql import statement as st

CLUSTER_LEAST = 50
GROUP = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order; compare nine decimals."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


def senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, sense, key, vector, topic) of every embedding."""
    v = load(spark, sf_dir, "embeddings")
    word = F.concat(F.lit("v"), F.floor(F.col("vec_id") / 3).cast("string"))
    return v.select(word.alias("word"), (F.col("vec_id") % 3).alias("sense"), F.concat(word, F.lit("_"), (F.col("vec_id") % 3).cast("string")).alias("key"), vectors.as_double(F.col("embedding")).alias("vector"), F.col("label").alias("topic"), F.floor(F.col("vec_id") / 3).alias("n"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(load(spark, sf_dir, "embeddings"), "label", "embedding")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.centroid_cosines(topics(spark, sf_dir), "label"), "cosine")


def knn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.nearest(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0), "cosine")


def centroid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics(spark, sf_dir).select("label", "n", F.posexplode("centroid").alias("i", "x"))
    return rounded(rows.select("label", "n", F.col("i").cast("long").alias("i"), "x"), "x")


def merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.merge_small_clusters(load(spark, sf_dir, "embeddings"), "label", "embedding", CLUSTER_LEAST)


def sense_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    word = F.concat(F.lit("w"), F.col("label").cast("string"))
    key = F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("_"), word)).when(F.col("vec_id") % 97 == 1, word).otherwise(F.concat(word, F.lit("_"), F.col("vec_id").cast("string")))
    return vectors.sense_keys(v.select(key.alias("key")))


def outlier_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test groups: a topic's words are dealt into groups of eight inliers, and each word of the next topic's group of that number is the outlier of a case. All words take part; a group without a counterpart makes no case."""
    nth = F.expr("row_number() OVER (PARTITION BY topic ORDER BY n) - 1")
    words = senses(spark, sf_dir).where("sense = 0").withColumn("_nth", nth).select("topic", "word", F.floor(F.col("_nth") / GROUP).alias("part"), (F.col("_nth") % GROUP + 1).alias("nth"))
    n = words.agg((F.max("topic") + 1).alias("topics"))
    outliers = words.crossJoin(F.broadcast(n)).select(F.pmod(F.col("topic") - 1, F.col("topics")).alias("topic"), "part", "word", "nth")
    outliers = outliers.withColumn("case", F.concat_ws("-", *(F.col(c).cast("string") for c in ("topic", "part", "nth"))))
    inliers = outliers.select("topic", "part", "case").join(words.select("topic", "part", "word"), ["topic", "part"]).select("case", "word", F.lit(False).alias("is_outlier"))
    return inliers.unionByName(outliers.select("case", "word", F.lit(True).alias("is_outlier")))


def outliers(spark: SparkSession, sf_dir: str, plain: bool) -> DataFrame:
    held = senses(spark, sf_dir)
    held = held.where("sense = 0") if plain else held
    return evaluation.outlier_positions(evaluation.outlier_scores(outlier_members(spark, sf_dir), held.select("word", "key", "vector"), -1.0 if plain else None))


def context_examples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Examples (item, word), their contexts (item, side, word, context) and gold (item, gold): a word between its followers on one side, between its predecessors on the other."""
    words = senses(spark, sf_dir).where("sense = 0").select("word", "n", "topic")
    examples = words.select(F.col("n").alias("item"), "word")
    near = F.expr("array(struct(1 AS side, n + 1 AS m), struct(1 AS side, n + 2 AS m), struct(2 AS side, n - 1 AS m), struct(2 AS side, n - 2 AS m))")
    contexts = words.select(F.col("n").alias("item"), "word", F.explode(near).alias("c")).select("item", "c.side", "word", F.concat(F.lit("v"), F.col("c.m").cast("string")).alias("context"))
    return examples, contexts, words.select(F.col("n").alias("item"), (F.col("topic") % 2 == 0).alias("gold"))


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples, contexts, _ = context_examples(spark, sf_dir)
    held = senses(spark, sf_dir).select("word", "key", "vector")
    return evaluation.words_in_context(examples, contexts, held, held)


def wic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarities(spark, sf_dir).select("item", "senses", F.round("similarity", 9).alias("similarity"), evaluation.same_sense(0.2).alias("same"))


def wic_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_scores(similarities(spark, sf_dir), context_examples(spark, sf_dir)[2])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.contingency(load(spark, sf_dir, "documents"), "lang", "source")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


def soft_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Soft gold and predicted labellings of the labelled documents by language: source and length class against quality and toxicity."""
    docs = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    row = lambda label, weight: F.struct(label.alias("label"), F.lit(weight).alias("weight"))
    name = lambda prefix, column: F.concat(F.lit(prefix), column.cast("string"))
    gold = F.array(row(F.col("source"), 0.625), row(name("n", F.col("n_chars") % 3), 0.375))
    predicted = F.array(row(name("q", F.col("quality")), 0.75), row(name("t", F.col("toxic")), 0.25))
    side = lambda labels: docs.select(F.col("lang").alias("word"), F.col("doc_id").alias("item"), F.explode(labels).alias("x")).select("word", "item", "x.*")
    return side(gold), side(predicted)


def key_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, keys and lemmas: every second word has numbered keys, every fifth a bare one, every seventh one in capitals; a word's lemma is the one of its number divided by four."""
    held = senses(spark, sf_dir)
    name = lambda n: F.concat(F.lit("v"), n.cast("string"))
    numbered = held.where("n % 2 = 0").select("key")
    bare = held.where("n % 5 = 0").select(F.when(F.col("n") % 7 == 0, F.upper("word")).otherwise(F.col("word")).alias("key"))
    words = held.select("word", name(F.floor(F.col("n") / 4)).alias("lemma")).distinct()
    return words.select("word"), numbered.union(bare).distinct(), words


def sense_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.candidate_keys(*key_tables(spark, sf_dir))


def cased_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, keys, _ = key_tables(spark, sf_dir)
    return evaluation.variant_keys(words, keys, 2)


def fallback_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's vector, of which two in three are missing: its first component and its length."""
    held = senses(spark, sf_dir)
    known = held.where("sense = 0 AND n % 3 = 0").select(F.col("word").alias("key"), "vector")
    unknown = held.where("n = 1 AND sense = 0").select(F.lit("UNK").alias("key"), "vector")
    found = evaluation.with_fallback(held.select("word").distinct(), known.union(unknown))
    return rounded(found.select("word", "known", F.col("vector")[0].alias("first"), norm(F.col("vector")).alias("length")), "first", "length")


def turn_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context words of one word of every turn: without itself, punctuation marks and stop words."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.lower(F.regexp_replace("text", "([.,!?])", " $1 ")), " +").alias("s"))
    words = evaluation.context_words(F.col("s"), F.col("turn") % F.size("s"))
    return turns.select("conv_id", "turn", F.array_join(words, " ").alias("context"))


def shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = senses(spark, sf_dir)
    return vectors.shrinkage(held.select("word", "key"), held.select("word", "topic").distinct())


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from senseloom.operators import text

    c = corpus.Corpus(spark, sf_dir)
    return vectors.tag_sentences(c.tokens, text.paragraphs(c.docs), c.assigned)


V = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings)"""
MEANS = """
parts AS (SELECT label, i, avg(e) AS e, count(*) AS n FROM (SELECT label, unnest(x) AS e, generate_subscripts(x, 1) - 1 AS i FROM v) GROUP BY ALL),
means AS (SELECT label, max(n) AS n, list(e ORDER BY i) AS x FROM parts GROUP BY label)"""
SENSES = """
s AS (SELECT 'v' || (vec_id // 3) AS word, vec_id % 3 AS sense, 'v' || (vec_id // 3) || '_' || (vec_id % 3) AS key, x, label AS topic, vec_id // 3 AS n FROM v)"""
MEMBERS = """
words8 AS (SELECT topic, word, r // 8 AS part, r % 8 + 1 AS nth FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n) - 1 AS r FROM s WHERE sense = 0)),
outl AS (SELECT (topic - 1 + (SELECT max(topic) + 1 FROM words8)) % (SELECT max(topic) + 1 FROM words8) AS topic, part, word, nth FROM words8),
member AS (SELECT concat_ws('-', o.topic, o.part, o.nth) AS "case", f.word, false AS is_outlier FROM outl o JOIN words8 f ON o.topic = f.topic AND o.part = f.part UNION ALL SELECT concat_ws('-', topic, part, nth), word, true FROM outl)"""
PLACE = """
place AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY score DESC, word DESC) - 1 AS position FROM scored)
SELECT "case", word, position FROM place WHERE is_outlier"""
WIC = """
words AS (SELECT * FROM s WHERE sense = 0),
ctx AS (SELECT n AS item, side, word, 'v' || (n + d) AS context FROM words, (VALUES (1, 1), (1, 2), (2, -1), (2, -2)) t(side, d)),
fit AS (SELECT o.item, o.side, k.key, k.x, avg(list_cosine_similarity(k.x, c.x)) AS fit FROM (SELECT DISTINCT item, side, word FROM ctx) o JOIN s k ON k.word = o.word LEFT JOIN (SELECT item, side, s.x FROM ctx JOIN s ON s.word = ctx.context) c ON c.item = o.item AND c.side = o.side GROUP BY ALL),
best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY item, side ORDER BY coalesce(fit, -2) DESC, key) = 1),
sim AS (SELECT w.n AS item, c.senses, CASE WHEN c.senses > 1 THEN list_cosine_similarity(a.x, b.x) END AS similarity, w.topic FROM words w JOIN (SELECT word, count(*) AS senses FROM s GROUP BY ALL) c USING (word) LEFT JOIN best a ON a.item = w.n AND a.side = 1 LEFT JOIN best b ON b.item = w.n AND b.side = 2)"""
KEYS = """
words AS (SELECT DISTINCT word, 'v' || (n // 4) AS lemma FROM s),
keys AS (SELECT key FROM s WHERE n % 2 = 0 UNION SELECT CASE WHEN n % 7 = 0 THEN upper(word) ELSE word END FROM s WHERE n % 5 = 0)"""
PUNCT = ", ".join("'" + ("''" if x == "'" else x) + "'" for x in evaluation.PUNCTUATION)
CELLS = """
cells AS (SELECT lang AS g, source AS p, count(*) AS n FROM documents GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY g)::BIGINT AS gn, sum(n) OVER (PARTITION BY p)::BIGINT AS pn, sum(n) OVER ()::BIGINT AS total FROM cells)"""
_LABELLED = "SELECT lang, source, quality, toxic FROM labels JOIN documents USING (doc_id)"

CATALOGUE = {
    "cosine_pairs": (cosine_pairs, st("SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.x, b.x), 9) AS cosine FROM means a JOIN means b ON a.label < b.label", V, MEANS)),
    "knn_vectors": (knn_vectors, st("SELECT * FROM (SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(q.x, r.x), 9) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.x, r.x) DESC, r.vec_id) AS rank FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10", V)),
    "centroids": (centroid_rows, st("SELECT label, n, i, round(e, 9) AS x FROM parts", V, MEANS)),
    "merge_small_clusters": (merge_small, st("SELECT cluster, size, dense_rank() OVER (ORDER BY home) - 1 AS merged FROM (SELECT m.label AS cluster, m.n AS size, coalesce((SELECT arg_max(b.label, (list_cosine_similarity(m.x, b.x), -b.label)) FROM means b WHERE b.n >= 50 AND m.n < 50), m.label) AS home FROM means m)", V, MEANS)),
    "sense_keys": (sense_keys, st("SELECT *, row_number() OVER (PARTITION BY word ORDER BY sense, key) AS rank FROM (SELECT 'w' || label AS word, key, coalesce(try_cast(nullif(split_part(key, '_', 2), '') AS BIGINT), 100) AS sense FROM (SELECT label, CASE WHEN vec_id % 5 = 0 THEN '_w' || label WHEN vec_id % 97 = 1 THEN 'w' || label ELSE 'w' || label || '_' || vec_id END AS key FROM v) WHERE NOT starts_with(key, '_'))", V)),
    "outlier_plain": (lambda s, d: outliers(s, d, True), "WITH " + ",".join((V, SENSES, MEMBERS, """
scored AS (SELECT a."case", a.word, a.is_outlier, sum(list_cosine_similarity(x.x, y.x)) AS score FROM member a JOIN member b ON a."case" = b."case" AND a.word <> b.word JOIN s x ON x.word = a.word AND x.sense = 0 JOIN s y ON y.word = b.word AND y.sense = 0 GROUP BY ALL)""", PLACE))),
    "outlier_sense": (lambda s, d: outliers(s, d, False), "WITH " + ",".join((V, SENSES, MEMBERS, """
per AS (SELECT a."case", a.word, a.is_outlier, x.key, b.word AS other, max(list_cosine_similarity(x.x, y.x)) AS c FROM member a JOIN member b ON a."case" = b."case" AND a.word <> b.word JOIN s x ON x.word = a.word JOIN s y ON y.word = b.word GROUP BY ALL),
own AS (SELECT "case", word, is_outlier, key, sum(c) AS t FROM per GROUP BY ALL),
scored AS (SELECT "case", word, is_outlier, max(t) AS score FROM own GROUP BY ALL)""", PLACE))),
    "outlier_summary": (lambda s, d: evaluation.outlier_summary(outliers(s, d, True)), "WITH " + ",".join((V, SENSES, MEMBERS, """
scored AS (SELECT a."case", a.word, a.is_outlier, sum(list_cosine_similarity(x.x, y.x)) AS score FROM member a JOIN member b ON a."case" = b."case" AND a.word <> b.word JOIN s x ON x.word = a.word AND x.sense = 0 JOIN s y ON y.word = b.word AND y.sense = 0 GROUP BY ALL)""", PLACE.replace('SELECT "case", word, position', "SELECT 100 * sum(position) / 8 / count(*) AS opp, count_if(position = 8) / count(*) AS accuracy")))),
    "wic_predict": (wic_predict, st("SELECT item, senses, round(similarity, 9) AS similarity, senses <= 1 OR coalesce(similarity > 0.2, false) AS same FROM sim", V, SENSES, WIC)),
    "wic_thresholds": (wic_thresholds, st("SELECT threshold, count_if(said AND gold)::BIGINT AS tp, count_if(said AND NOT gold)::BIGINT AS fp, count_if(NOT said AND gold)::BIGINT AS fn, count_if(NOT said AND NOT gold)::BIGINT AS tn, 100 * (count_if(said = gold)) / count(*) AS accuracy FROM (SELECT t / 100.0::DOUBLE AS threshold, topic % 2 = 0 AS gold, senses <= 1 OR coalesce(similarity > t / 100.0::DOUBLE, false) AS said FROM sim, range(50, 80, 2) r(t)) GROUP BY ALL", V, SENSES, WIC)),
    "wic_best_threshold": (lambda s, d: evaluation.best_threshold(wic_thresholds(s, d)).select("threshold", "accuracy"), st("SELECT threshold, 100 * count_if(said = gold) / count(*) AS accuracy FROM (SELECT t / 100.0::DOUBLE AS threshold, topic % 2 = 0 AS gold, senses <= 1 OR coalesce(similarity > t / 100.0::DOUBLE, false) AS said FROM sim, range(50, 80, 2) r(t)) GROUP BY threshold ORDER BY accuracy DESC, threshold LIMIT 1", V, SENSES, WIC)),
    "sense_candidates": (sense_candidates, st("SELECT word, key, row_number() OVER (PARTITION BY word ORDER BY turn, place) - 1 AS nth FROM (SELECT word, key, min(turn) AS turn, arg_min(place, turn) AS place FROM (SELECT * FROM held WHERE place < 10 OR NOT EXISTS (SELECT 1 FROM held h WHERE h.word = held.word AND h.turn = held.turn AND h.place < 10)) GROUP BY ALL)", V, SENSES, KEYS, """
stems AS (SELECT word, word AS stem, 0 AS turn FROM words UNION ALL SELECT word, lemma, 1 FROM words WHERE lemma <> word),
held AS (SELECT s.word, s.turn, p.place, k.key FROM stems s, range(0, 11) p(place) JOIN keys k ON k.key = CASE WHEN p.place < 10 THEN s.stem || '_' || p.place ELSE s.stem END)""")),
    "cased_keys": (cased_keys, st("SELECT DISTINCT w.word, k.key FROM words w, (VALUES (''), ('_0'), ('_1')) e(x) JOIN keys k ON k.key IN (w.word || e.x, upper(left(w.word, 1)) || substr(w.word, 2) || e.x, upper(w.word) || e.x)", V, SENSES, KEYS)),
    "fallback_vectors": (fallback_norms, st("SELECT w.word, k.x IS NOT NULL AS known, round(CASE WHEN k.x IS NULL THEN u.x[1] ELSE k.x[1] / sqrt(list_inner_product(k.x, k.x)) END, 9) AS first, round(CASE WHEN k.x IS NULL THEN sqrt(list_inner_product(u.x, u.x)) ELSE 1 END, 9) AS length FROM (SELECT DISTINCT word FROM s) w LEFT JOIN (SELECT word, x FROM s WHERE sense = 0 AND n % 3 = 0) k USING (word), (SELECT x FROM s WHERE n = 1 AND sense = 0) u", V, SENSES)),
    "context_words": (turn_contexts, f"SELECT conv_id, turn, array_to_string(list_filter(ws, lambda w, i: i <> turn % len(ws) + 1 AND w NOT IN ({PUNCT}) AND w NOT IN ({STOPS})), ' ') AS context FROM (SELECT conv_id, turn, regexp_split_to_array(lower(regexp_replace(text, '([.,!?])', ' \\1 ', 'g')), ' +') AS ws FROM conversations)"),
    "sense_examples": (lambda s, d: (lambda c: sense_ops.examples(c.assigned, c.docs))(corpus.Corpus(s, d)), st("SELECT f.lemma, f.sense_id, f.nth, f.file_id, f.pos, string_agg(t.token, ' ' ORDER BY t.pos) AS example FROM (SELECT *, row_number() OVER (PARTITION BY lemma, sense_id ORDER BY file_id, pos) AS nth FROM assigned QUALIFY nth <= 5) f JOIN tok t ON t.file_id = f.file_id AND t.pos BETWEEN f.pos - 8 AND f.pos + 8 GROUP BY ALL", *corpus.SENSE, corpus.sql.ASSIGNED, recursive=True)),
    "v_measure": (lambda s, d: rounded(evaluation.v_measure(cells(s, d)), "homogeneity", "completeness", "v_measure"), st("SELECT round(h, 9) AS homogeneity, round(k, 9) AS completeness, round(2 * h * k / (h + k), 9) AS v_measure FROM (SELECT 1 - sum(-(n / total) * ln(n / pn)) / sum(-(n / total) * ln(gn / total)) AS h, 1 - sum(-(n / total) * ln(n / gn)) / sum(-(n / total) * ln(pn / total)) AS k FROM c)", CELLS)),
    "paired_fscore": (lambda s, d: evaluation.paired_f_score(cells(s, d)), st("SELECT shared, predicted_pairs, gold_pairs, 2 * shared / (predicted_pairs + gold_pairs) AS f_score FROM (SELECT (SELECT sum(n * (n - 1) // 2)::BIGINT FROM cells) AS shared, (SELECT sum(n * (n - 1) // 2)::BIGINT FROM (SELECT sum(n)::BIGINT AS n FROM cells GROUP BY p)) AS predicted_pairs, (SELECT sum(n * (n - 1) // 2)::BIGINT FROM (SELECT sum(n)::BIGINT AS n FROM cells GROUP BY g)) AS gold_pairs)", CELLS)),
    "b_cubed": (lambda s, d: rounded(evaluation.b_cubed(cells(s, d)), "precision", "recall", "f_score"), st("SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f_score FROM (SELECT sum(n * n / pn) / max(total) AS p, sum(n * n / gn) / max(total) AS r FROM c)", CELLS)),
    "fuzzy_nmi": (lambda s, d: rounded(evaluation.fuzzy_nmi(labelled(s, d).select(F.col("doc_id").alias("item"), F.col("lang").alias("g"), F.lit(1.0).alias("gw"), F.explode(F.array(F.struct(F.concat(F.lit("q"), F.col("quality")).alias("p"), F.lit(0.75).alias("w")), F.struct(F.concat(F.lit("t"), F.col("toxic")).alias("p"), F.lit(0.25).alias("w")))).alias("x")).select("item", "g", "gw", "x.p", F.col("x.w").alias("pw"))), "fuzzy_nmi"), f"""WITH l AS ({_LABELLED}), m AS (SELECT lang AS g, 'q' || quality AS p, 0.75::DOUBLE AS w FROM l UNION ALL SELECT lang, 't' || toxic, 0.25::DOUBLE FROM l),
j AS (SELECT g, p, sum(w) AS n FROM m GROUP BY ALL), c AS (SELECT n, sum(n) OVER (PARTITION BY g) AS gn, sum(n) OVER (PARTITION BY p) AS pn, sum(n) OVER () AS total FROM j)
SELECT round(sum(n / total * ln(n * total / (gn * pn))) / greatest(sum(-n / total * ln(gn / total)), sum(-n / total * ln(pn / total))), 9) AS fuzzy_nmi FROM c"""),
    "fuzzy_b_cubed": (lambda s, d: rounded(evaluation.fuzzy_b_cubed(*soft_labels(s, d)), "precision", "recall", "f_score"), """WITH l AS (SELECT lang AS word, doc_id AS item, source, n_chars % 3 AS c, quality, toxic FROM labels JOIN documents USING (doc_id)),
o AS (SELECT a.word, a.item, (a.source = b.source)::INT * 0.625::DOUBLE + (a.c = b.c)::INT * 0.375::DOUBLE AS g, (a.quality = b.quality)::INT * 0.75::DOUBLE + (a.toxic = b.toxic)::INT * 0.25::DOUBLE AS p FROM l a JOIN l b ON a.word = b.word AND a.item <> b.item),
i AS (SELECT word, item, avg(least(g, p) / p) FILTER (p > 0) AS pr, avg(least(g, p) / g) FILTER (g > 0) AS re FROM o GROUP BY ALL),
w AS (SELECT word, coalesce(avg(pr), 0) AS pr, coalesce(avg(re), 0) AS re FROM (SELECT DISTINCT word FROM l) LEFT JOIN i USING (word) GROUP BY word)
SELECT word, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f_score FROM w"""),
    "score_by_group": (lambda s, d: rounded(evaluation.score_by_group(labelled(s, d), "lang", ["quality", "toxic"]), "quality", "toxic", "score"), f"SELECT lang, round(q, 9) AS quality, round(t, 9) AS toxic, round(sqrt(q * t), 9) AS score FROM (SELECT lang, avg(quality) AS q, avg(toxic) AS t FROM ({_LABELLED}) GROUP BY lang)"),
    "gold_crosstab": (lambda s, d: evaluation.crosstab(labelled(s, d), "lang", "quality", [0, 1]), f"SELECT lang, count_if(quality = 0)::BIGINT AS quality_0, count_if(quality = 1)::BIGINT AS quality_1 FROM ({_LABELLED}) GROUP BY lang"),
    "sense_shrinkage": (shrinkage, st("SELECT before, after, before_many, after_many, (before - after) / before AS shrunk, (before_many - after_many) / before_many AS shrunk_many FROM (SELECT sum(b)::BIGINT AS before, sum(a)::BIGINT AS after, sum(CASE WHEN b > 1 THEN b ELSE 0 END)::BIGINT AS before_many, sum(CASE WHEN b > 1 THEN a ELSE 0 END)::BIGINT AS after_many FROM (SELECT word, count(*) AS b, count(DISTINCT topic) AS a FROM s GROUP BY word))", V, SENSES)),
    "tfidf_bow": (lambda s, d: rounded(vectors.tfidf(corpus.Corpus(s, d).stage), "idf"), st("SELECT lemma, token, df, n, round(ln((1 + n) / (1 + df)) + 1, 9) AS idf FROM (SELECT lemma, sub AS token, count(*) AS df FROM subs GROUP BY ALL) JOIN (SELECT lemma, count(*) AS n FROM (SELECT DISTINCT lemma, file_id, pos FROM subs) GROUP BY ALL) USING (lemma)", *corpus.GRAPH[:4])),
    "tagged_sentences": (lambda s, d: tagged(s, d).select("file_id", "paragraph", F.array_join("words", " ").alias("sentence")), st("SELECT file_id, paragraph, replace(string_agg(piece, ' ' ORDER BY pos), ' ##', '') AS sentence FROM (SELECT t.file_id, t.pos, p.paragraph, t.token || coalesce('_' || a.sense_id, '') AS piece FROM tok t LEFT JOIN assigned a USING (file_id, pos) JOIN para p ON t.file_id = p.file_id AND t.pos >= p.s AND t.pos < p.s + p.n) GROUP BY ALL", *corpus.SENSE, corpus.sql.ASSIGNED, corpus.PARAGRAPHS, recursive=True)),
}

ROWS_ONLY = {
    "hac_senses": lambda s, d: vectors.hac_senses(corpus.Corpus(s, d).cleaned().select("lemma", "file_id", "pos", "reps")),
    "merge_close_senses": lambda s, d: vectors.merge_close_senses(senses(s, d), 0.3),
    "word2vec_senses": lambda s, d: vectors.word2vec(tagged(s, d)),
    "cbow_senses": lambda s, d: cbow.cbow(tagged(s, d)),
}

QUERIES = {k: v[0] for k, v in CATALOGUE.items()} | ROWS_ONLY
ORACLES = {k: v[1] for k, v in CATALOGUE.items()}
