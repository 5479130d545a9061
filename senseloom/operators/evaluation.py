"""Evaluation: clusterings against gold, words in context, outliers, scores by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from senseloom.functions.arrays import cosine, let, norm
from senseloom.functions.stopwords import STOP_WORDS
from senseloom.functions.storage import stored

# The punctuation marks of ASCII.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
THRESHOLDS = tuple(x / 100 for x in range(50, 80, 2))


def contingency(items: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Rows (g, p, n, gn, pn, total): counts of each pair of labels, of each label and of all. Everything after this is small."""
    cells = items.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    over = lambda *keys: F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return cells.select("g", "p", "n", over("g").alias("gn"), over("p").alias("pn"), over().alias("total"))


def v_measure(cells: DataFrame) -> DataFrame:
    """homogeneity, completeness, v_measure; a clustering with one gold label is homogeneous, one with one cluster complete."""
    plogp = lambda part, whole: F.sum(-(F.col("n") / F.col("total")) * F.log(F.col(part) / F.col(whole)))
    h = cells.agg(plogp("n", "pn").alias("hgp"), plogp("n", "gn").alias("hpg"), plogp("gn", "total").alias("hg"), plogp("pn", "total").alias("hp"))
    h = h.select(F.when(F.col("hg") == 0, 1.0).otherwise(1 - F.col("hgp") / F.col("hg")).alias("homogeneity"), F.when(F.col("hp") == 0, 1.0).otherwise(1 - F.col("hpg") / F.col("hp")).alias("completeness"))
    total = F.col("homogeneity") + F.col("completeness")
    return h.withColumn("v_measure", F.when(total > 0, 2 * F.col("homogeneity") * F.col("completeness") / total).otherwise(0.0))


def paired_f_score(cells: DataFrame) -> DataFrame:
    """shared, predicted and gold pairs of items in one group, and the F-score of the pairs (0 without shared pairs)."""
    pairs = lambda n: n * (n - 1) / 2
    once = lambda c: F.sum(F.when(F.col(f"first_{c}"), pairs(F.col(f"{c}n"))).otherwise(0)).cast("long")
    marked = cells
    for c, other in (("g", "p"), ("p", "g")):
        marked = marked.withColumn(f"first_{c}", F.row_number().over(Window.partitionBy(c).orderBy(other)) == 1)
    sums = marked.agg(F.sum(pairs(F.col("n"))).cast("long").alias("shared"), once("p").alias("predicted_pairs"), once("g").alias("gold_pairs"))
    return sums.withColumn("f_score", F.when(F.col("shared") > 0, 2 * F.col("shared") / (F.col("predicted_pairs") + F.col("gold_pairs"))).otherwise(0.0))


def b_cubed(cells: DataFrame) -> DataFrame:
    """B-cubed precision, recall and F-score of a hard clustering."""
    mean = lambda c: F.sum(F.col("n") * F.col("n") / F.col(c)) / F.max("total")
    pr = cells.agg(mean("pn").alias("precision"), mean("gn").alias("recall"))
    return pr.withColumn("f_score", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def _overlap(a: Column, b: Column) -> Column:
    """Sum over shared labels of the smaller weight; ``a`` and ``b`` are arrays of (label, weight)."""
    of = lambda x: F.aggregate(F.filter(b, lambda y: y["label"] == x["label"]), F.lit(0.0), lambda s, y: s + F.least(x["weight"], y["weight"]))
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + of(x))


def fuzzy_b_cubed(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Fuzzy B-cubed of soft labellings by word: (word, precision, recall, f_score).

    ``gold`` and ``predicted`` have word, item, label and weight (not negative; an item's weights are divided by their sum). Two items overlap by the sum of the smaller weights of shared labels. An item's
    precision is the mean, over the other items that overlap with it in the prediction, of min(both overlaps) over the predicted one; recall likewise over gold. Means are taken over the items that have such
    others; without any they are 0. Items of one pair of labellings are alike and are counted as one profile with a number, so pairs are made of distinct profiles that share a label, and an item in one labelling alone is
    left out.
    """

    def side(labels: DataFrame, name: str) -> DataFrame:
        total = F.sum("weight").over(Window.partitionBy("word", "item"))
        shares = labels.groupBy("word", "item", "label").agg(F.sum("weight").alias("weight")).where("weight > 0").withColumn("weight", F.col("weight") / total)
        return shares.groupBy("word", "item").agg(F.array_sort(F.collect_list(F.struct("label", "weight"))).alias(name))

    profiles = side(gold, "g").join(side(predicted, "p"), ["word", "item"]).groupBy("word", "g", "p").agg(F.count("*").alias("n"))
    profiles = stored(profiles.withColumn("id", F.monotonically_increasing_id()), "profiles")

    def mean(by: str, other: str, name: str) -> DataFrame:
        shared = profiles.select("word", "id", F.explode(F.transform(by, lambda x: x["label"])).alias("label"))
        pairs = shared.join(shared.withColumnRenamed("id", "other"), ["word", "label"]).select("word", "id", "other").distinct()
        a = profiles.select("id", F.col(by).alias("a"), F.col(other).alias("c"), "n")
        b = profiles.select(F.col("id").alias("other"), F.col(by).alias("b"), F.col(other).alias("d"), F.col("n").alias("m"))
        met = pairs.join(a, "id").join(b, "other").withColumn("m", F.col("m") - (F.col("id") == F.col("other")).cast("long")).where("m > 0")
        base = _overlap(F.col("a"), F.col("b"))
        part = F.least(base, _overlap(F.col("c"), F.col("d"))) / base
        per = met.groupBy("word", "id").agg(F.max("n").alias("n"), (F.sum(F.col("m") * part) / F.sum("m")).alias("x"))
        return per.groupBy("word").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias(name))

    words = profiles.select("word").distinct()
    scored = words.join(mean("p", "g", "precision"), "word", "left").join(mean("g", "p", "recall"), "word", "left").fillna(0.0)
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f_score", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def fuzzy_nmi(weights: DataFrame) -> DataFrame:
    """Normalised mutual information of soft labellings, re-derived: weights (item, g, gw, p, pw) are joint masses gw * pw, normalised per item."""
    mass = weights.withColumn("w", F.col("gw") * F.col("pw"))
    mass = mass.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("item")))
    cells = mass.groupBy("g", "p").agg(F.sum("w").alias("n"))
    over = lambda *keys: F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    cells = cells.select("n", over("g").alias("gn"), over("p").alias("pn"), over().alias("total"))
    mutual = F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("gn") * F.col("pn"))))
    h = lambda c: F.sum(-F.col("n") / F.col("total") * F.log(F.col(c) / F.col("total")))
    return cells.agg(mutual.alias("mi"), h("gn").alias("hg"), h("pn").alias("hp")).select(F.when(F.greatest("hg", "hp") > 0, F.col("mi") / F.greatest("hg", "hp")).otherwise(1.0).alias("fuzzy_nmi"))


def score_by_group(scores: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric by group, and the square root of the product of the means."""
    means = scores.groupBy(group).agg(*(F.avg(m).alias(m) for m in metrics))
    product = F.lit(1.0)
    for m in metrics:
        product = product * F.col(m)
    return means.withColumn("score", F.sqrt(product))


def crosstab(items: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts of ``columns`` values by ``rows``, one column per listed value."""
    return items.groupBy(rows).agg(*(F.count_if(F.col(columns) == v).alias(f"{columns}_{v}") for v in values))


def likely_senses(contexts: DataFrame, senses: DataFrame, context_vectors: DataFrame) -> DataFrame:
    """The sense of a word that best fits its context: (item, side, key, vector).

    ``contexts`` has item, side, word and the context word; a sense is scored by its mean cosine to all vectors of the context words, ties by key; without any context
    vector the first key is taken. ``senses`` and ``context_vectors`` have word, key and vector.
    """
    own = contexts.select("item", "side", "word").distinct().join(senses, "word")
    around = contexts.select("item", "side", F.col("context").alias("word")).join(context_vectors, "word").select("item", "side", F.col("vector").alias("c"))
    scored = own.join(around, ["item", "side"], "left").groupBy("item", "side", "key").agg(F.avg(cosine(F.col("vector"), F.col("c"))).alias("fit"))
    best = scored.groupBy("item", "side").agg(F.min_by("key", F.struct((-F.coalesce("fit", F.lit(-2.0))).alias("f"), "key")).alias("key"))
    return best.join(senses.select("key", "vector"), "key")


def words_in_context(examples: DataFrame, contexts: DataFrame, senses: DataFrame, context_vectors: DataFrame) -> DataFrame:
    """(item, senses, similarity): candidate senses of each example's word and the cosine of the senses of its two sides; null with one sense or none."""
    n = senses.groupBy("word").agg(F.count("*").alias("senses"))
    chosen = likely_senses(contexts, senses, context_vectors)
    side = lambda s, name: chosen.where(F.col("side") == s).select("item", F.col("vector").alias(name))
    joined = examples.join(n, "word", "left").join(side(1, "a"), "item", "left").join(side(2, "b"), "item", "left")
    return joined.select("item", F.coalesce("senses", F.lit(0).cast("long")).alias("senses"), F.when(F.col("senses") > 1, cosine(F.col("a"), F.col("b"))).alias("similarity"))


def same_sense(threshold: float | Column) -> Column:
    """True with at most one candidate sense or a similarity strictly above the threshold."""
    return (F.col("senses") <= 1) | F.coalesce(F.col("similarity") > threshold, F.lit(False))


def threshold_scores(similarities: DataFrame, gold: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Confusion counts and accuracy (%) of each threshold: (threshold, tp, fp, fn, tn, accuracy). The thresholds are a short list."""
    rows = similarities.join(gold, "item").withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds)))).withColumn("said", same_sense(F.col("threshold")))
    n = lambda when, name: F.count_if(when).alias(name)
    counts = rows.groupBy("threshold").agg(n(F.col("said") & F.col("gold"), "tp"), n(F.col("said") & ~F.col("gold"), "fp"), n(~F.col("said") & F.col("gold"), "fn"), n(~F.col("said") & ~F.col("gold"), "tn"), F.count("*").alias("n"))
    return counts.withColumn("accuracy", 100 * (F.col("tp") + F.col("tn")) / F.col("n")).drop("n")


def best_threshold(scores: DataFrame) -> DataFrame:
    """The threshold of greatest accuracy, of equal ones the first."""
    return scores.orderBy(F.desc("accuracy"), "threshold").limit(1)


def with_fallback(words: DataFrame, vectors: DataFrame, unknown: str = "UNK") -> DataFrame:
    """(word, vector, known) of each word: its own vector at length 1, or the one of ``unknown`` as it is where the word has none. ``vectors`` has key and vector, one row per key.

    Without a vector of ``unknown`` such words get null; a vector of zeros stays one.
    """
    own = vectors.select(F.col("key").alias("word"), F.col("vector").alias("_own"))
    other = vectors.where(F.col("key") == unknown).agg(F.first("vector").alias("_other"))  # one row
    joined = words.select("word").join(own, "word", "left").crossJoin(F.broadcast(other))
    unit = let(norm(F.col("_own")), lambda n: F.when(n > 0, F.transform("_own", lambda x: x / n)).otherwise(F.col("_own")))
    return joined.select("word", F.when(F.col("_own").isNotNull(), unit).otherwise(F.col("_other")).alias("vector"), F.col("_own").isNotNull().alias("known"))


def candidate_keys(words: DataFrame, keys: DataFrame, lemmas: DataFrame | None = None, most: int = 10) -> DataFrame:
    """The sense keys that a word may have: (word, key, nth) in order, nth from 0.

    These are word_0 .. word_9 as far as they are among ``keys`` (key), the bare word only if there is none of them, and after these the lemma's, found likewise, that are not among them already.
    ``lemmas`` has word and lemma. Keys are made from the words and kept by a semi-join, so the keys' table is not searched by prefix.
    """
    asked = words.select("word").distinct()
    of = asked.select("word", F.col("word").alias("stem"), F.lit(0).alias("turn"))
    if lemmas is not None:
        of = of.union(asked.join(lemmas.select("word", F.col("lemma").alias("stem")), "word").where("stem <> word").select("word", "stem", F.lit(1).alias("turn")))
    numbered = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.struct(F.concat("stem", F.lit("_"), i.cast("string")).alias("key"), i.alias("place")))
    made = of.select("word", "turn", F.explode(F.concat(numbered, F.array(F.struct(F.col("stem").alias("key"), F.lit(most).alias("place"))))).alias("k")).select("word", "turn", "k.*")
    held = made.join(keys.select("key").distinct(), "key", "left_semi")
    least = F.min("place").over(Window.partitionBy("word", "turn"))
    kept = held.withColumn("_least", least).where((F.col("place") < most) | (F.col("_least") == most))
    first = kept.groupBy("word", "key").agg(F.min(F.struct("turn", "place")).alias("at"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy("at")).cast("long") - 1).select("word", "key", "nth")


def case_variants(word: Column) -> Column:
    """The word as it is, capitalised, and in capitals, each form once."""
    return F.array_distinct(F.array(word, F.initcap(word), F.upper(word)))


def variant_keys(words: DataFrame, keys: DataFrame, senses: int = 3) -> DataFrame:
    """(word, key): the keys of a word in all its cases, bare and with the first ``senses`` numbers, that are among ``keys`` (key): the variants that :func:`outlier_scores` takes as a word's own."""
    form = words.select("word").distinct().select("word", F.explode(case_variants(F.col("word"))).alias("form"))
    ends = F.array(F.lit(""), *(F.lit(f"_{i}") for i in range(senses)))
    made = form.select("word", F.explode(F.transform(ends, lambda e: F.concat("form", e))).alias("key")).distinct()
    return made.join(keys.select("key").distinct(), "key", "left_semi").select("word", "key")


def context_words(sentence: Column, position: Column, punctuation: str = PUNCTUATION) -> Column:
    """The words of a sentence (array) but for the one at ``position`` (from 0), single punctuation marks and stop words."""
    return F.filter(sentence, lambda x, i: (i != position) & ~x.isin(*punctuation) & ~x.isin(*STOP_WORDS))


def ordered_union(a: Column, b: Column) -> Column:
    """The keys of two lists, each once, in order; if any is a numbered sense (with _), only those."""
    both = lambda keys: let(F.filter(keys, lambda k: k.contains("_")), lambda s: F.when(F.size(s) > 0, s).otherwise(keys))
    return let(F.array_distinct(F.concat(a, b)), both)


def outlier_scores(members: DataFrame, vectors: DataFrame, missing: float | None = -1.0) -> DataFrame:
    """Compactness of each word of a test group: (case, word, is_outlier, score).

    ``members`` has case, word and is_outlier, ``vectors`` word, key and vector (several keys are variants or senses). With ``missing`` a pair's similarity is the
    greatest over both words' keys (or ``missing``) and a score the sum over the others; without, a score is the greatest over the word's own keys of the sum of the greatest over
    each other's, and words without keys are skipped (0).
    """
    held = members.join(vectors, "word", "left").select("case", "word", "is_outlier", "key", "vector")
    other = held.select("case", F.col("word").alias("other"), F.col("key").alias("other_key"), F.col("vector").alias("other_vector"))
    pairs = held.join(other, "case").where("word <> other").withColumn("c", cosine(F.col("vector"), F.col("other_vector")))
    if missing is None:
        per = pairs.groupBy("case", "word", "is_outlier", "key", "other").agg(F.max("c").alias("c")).groupBy("case", "word", "is_outlier", "key").agg(F.sum("c").alias("s"))
        return per.groupBy("case", "word", "is_outlier").agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("score"))
    per = pairs.groupBy("case", "word", "is_outlier", "other").agg(F.coalesce(F.max("c"), F.lit(missing)).alias("c"))
    return per.groupBy("case", "word", "is_outlier").agg(F.sum("c").alias("score"))


def outlier_positions(scores: DataFrame) -> DataFrame:
    """(case, word, position): place of the outlier among its group by (score, word) descending, from 0."""
    order = Window.partitionBy("case").orderBy(F.desc("score"), F.desc("word"))
    return scores.withColumn("position", F.row_number().over(order).cast("long") - 1).where("is_outlier").select("case", "word", "position")


def outlier_summary(positions: DataFrame, inliers: int = 8) -> DataFrame:
    """Mean position in percent of the last place, and the share of cases with the outlier last."""
    last = F.col("position") == inliers
    return positions.agg((100 * F.sum("position") / inliers / F.count("*")).alias("opp"), (F.count_if(last) / F.count("*")).alias("accuracy"))
