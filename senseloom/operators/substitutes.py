"""Ranked substitutes of occurrences: providers and the fixed order of cleaning.

The distributional provider ranks the tokens that stand between the same two neighbours anywhere in the corpus. Fillers are kept by context and
joined to occurrences as one array, so that cleaning is array functions within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from senseloom.functions.arrays import first_of_each, let
from senseloom.functions.storage import bucketed, stored
from senseloom.operators.text import is_stop

KEPT = 100
#: A table of at most so many rows is broadcast.
SMALL = 200_000


def context_fillers(index: DataFrame, kept: int = KEPT + 1) -> DataFrame:
    """prev, next, token, lemma, cnt, rank: the ``kept`` most frequent tokens of each context that has at least two. Occurrences are dealt by context once; most contexts are rare, so sums before that would save little."""
    dealt = index.where("prev IS NOT NULL AND next IS NOT NULL").select("prev", "next", "token", "lemma").repartition("prev", "next")
    counted = dealt.groupBy("prev", "next", "token", "lemma").agg(F.count("*").alias("cnt"))
    context = Window.partitionBy("prev", "next")
    ranked = counted.withColumn("rank", F.row_number().over(context.orderBy(F.desc("cnt"), "token")).cast("long")).where(F.col("rank") <= kept)
    return ranked.withColumn("_n", F.count("*").over(context)).where("_n > 1").drop("_n")


def substitutes(occurrences: DataFrame, fillers: DataFrame, kept: int = KEPT) -> DataFrame:
    """Add ``reps``: array of (token, lemma, cnt) by rank, without the occurrence's own token, ``kept`` at most. Occurrences without any go."""
    held = fillers.groupBy("prev", "next").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "lemma", "cnt"))).alias("all"))
    joined = occurrences.join(held, ["prev", "next"])
    other = F.slice(F.filter("all", lambda x: x["token"] != F.col("token")), 1, kept)
    reps = F.transform(other, lambda x: F.struct(x["token"].alias("token"), x["lemma"].alias("lemma"), x["cnt"].alias("cnt")))
    return joined.withColumn("reps", reps).drop("all").where(F.size("reps") > 0)


def from_table(occurrences: DataFrame, replacements: DataFrame, vocab: DataFrame, kept: int = KEPT) -> DataFrame:
    """The same from a precomputed table (file_id, pos, reps, probs) by rank; ``cnt`` holds the probabilities.

    The entry equal to the token is dropped, or the last one beyond ``kept`` if it is absent.
    """
    flat = occurrences.join(replacements, ["file_id", "pos"]).withColumn("x", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("reps")).alias("rank"), "reps", "probs"))).select(*occurrences.columns, F.col("x.rank").alias("rank"), F.col("x.reps").alias("rep"), F.col("x.probs").alias("cnt"))
    known = vocab.select(F.col("token").alias("rep"), F.col("lemma").alias("rep_lemma"))
    named = flat.where("rep <> token").join(known, "rep", "left").withColumn("s", F.struct("rank", F.col("rep").alias("token"), F.coalesce("rep_lemma", "rep").alias("lemma"), "cnt"))
    grouped = named.groupBy(*occurrences.columns).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.withColumn("reps", F.transform(F.slice("s", 1, kept), lambda x: F.struct(x["token"].alias("token"), x["lemma"].alias("lemma"), x["cnt"].alias("cnt")))).drop("s")


def clean(found: DataFrame, n: int, drop_query: bool = True) -> DataFrame:
    """Clean ``reps`` in the fixed order: half and stop words, lemmas (first of each stays), the query word, the first ``n``; empty ones go.

    The result's ``reps`` are lemmas by rank and ``probs`` their shares, renormalised to sum to 1.
    """
    usable = F.filter("reps", lambda x: ~x["token"].startswith("##") & ~is_stop(x["token"]))
    lemmas = first_of_each(usable, "lemma")
    if drop_query:
        lemmas = F.filter(lemmas, lambda x: x["lemma"] != F.col("lemma"))
    cut = found.withColumn("reps", F.slice(lemmas, 1, n)).where(F.size("reps") > 0)
    probs = let(F.aggregate("reps", F.lit(0.0), lambda s, x: s + x["cnt"]), lambda total: F.transform("reps", lambda x: x["cnt"] / total))
    return cut.withColumn("probs", probs).withColumn("reps", F.transform("reps", lambda x: x["lemma"]))


def query_variants(words: DataFrame, vocab: DataFrame, most: int = SMALL) -> DataFrame:
    """(word, token): what to remove from the substitutes of each query word of ``words`` (word).

    That are the word as it is, in lower case and capitalised, as far as they are tokens of ``vocab`` (token, lemma), and every token whose lemma is removed already when the map of tokens to lemmas is gone through in the
    order of tokens. So along a chain of lemmas only tokens that come later than their lemma follow it. Each round goes one lemma further and takes what is new; a chain's tokens ascend, so
    the rounds end.
    """
    lemmas = vocab.select(F.col("token").alias("next"), F.col("lemma").alias("token")).where("next <> token")
    lemmas = F.broadcast(lemmas) if lemmas.limit(most + 1).count() <= most else lemmas
    forms = F.array_distinct(F.array("word", F.lower("word"), F.initcap(F.lower("word"))))
    asked = words.select("word").distinct().select("word", F.explode(forms).alias("token"))
    seen = stored(asked.join(vocab.select("token").distinct(), "token", "left_semi").select("word", "token", F.lit(True).alias("given")), "variants")
    new = seen
    while not new.isEmpty():
        found = new.join(lemmas, "token").where(F.col("given") | (F.col("next") > F.col("token"))).select("word", F.col("next").alias("token")).distinct()
        new = stored(found.join(seen.select("word", "token"), ["word", "token"], "left_anti").withColumn("given", F.lit(False)), "variants")
        seen = stored(seen.unionByName(new), "variants")
    return seen.select("word", "token")


def without_words(cleaned: DataFrame, variants: DataFrame, word: str, most: int = SMALL) -> DataFrame:
    """Take the variants of each row's query word (column ``word``) out of its ``reps``, and their ``probs`` if there are any; rows with none left go.

    The words' variants travel as one array each, broadcast after a count.
    """
    held = variants.groupBy(F.col("word").alias("_word")).agg(F.collect_set("token").alias("_out"))
    held = F.broadcast(held) if held.limit(most + 1).count() <= most else held
    joined = cleaned.join(held, F.col(word) == F.col("_word"), "left").withColumn("_out", F.coalesce("_out", F.array().cast("array<string>")))
    stays = lambda x: ~F.array_contains("_out", x)
    if "probs" in cleaned.columns:
        joined = joined.withColumn("probs", F.transform(F.filter(F.arrays_zip("reps", "probs"), lambda x: stays(x["reps"])), lambda x: x["probs"]))
    return joined.withColumn("reps", F.filter("reps", stays)).where(F.size("reps") > 0).select(*cleaned.columns)


def leading(fillers: DataFrame, n: int, dealt: bool = False) -> DataFrame:
    """The fillers that can be among an occurrence's first ``n`` lemmas, as one array by rank for each context: (prev, next, lead).

    Of each lemma only the first filler counts, or the second if the first is the occurrence's own token; ``before`` says which of the two it is and ``own`` names
    the first. Beyond the (n + 1)-th lemma nothing is needed, as an occurrence takes out one lemma at most. A context's list serves all its occurrences, so an
    occurrence looks at twice that many fillers and not at all of them. ``dealt`` says that a context's fillers lie together already.
    """
    lemma, context = Window.partitionBy("prev", "next", "lemma").orderBy("rank"), Window.partitionBy("prev", "next").orderBy("rank")
    usable = fillers.where(~F.col("token").startswith("##") & ~is_stop(F.col("token")))
    usable = usable if dealt else usable.repartition("prev", "next")  # serves both windows, the arrays and the join
    marked = usable.withColumn("before", F.row_number().over(lemma) - 1).withColumn("own", F.first("token").over(lemma)).where("before <= 1")
    cut = marked.withColumn("_nth", F.count_if(F.col("before") == 0).over(context)).where(F.col("_nth") <= n + 1)
    return cut.groupBy("prev", "next").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "lemma", "cnt", "before", "own"))).alias("lead"))


def nearest(occurrences: DataFrame, fillers: DataFrame, n: int, drop_query: bool = True, kept: int = KEPT) -> DataFrame:
    """:func:`substitutes` and :func:`clean` in one: occurrences with ``reps``, the first ``n`` lemmas of their context's other fillers, and ``probs``; those without any go.

    As there, only the first ``kept`` fillers other than the own token count.
    """
    return _chosen(occurrences.join(leading(fillers, n), ["prev", "next"]), n, drop_query, kept)


def _chosen(joined: DataFrame, n: int, drop_query: bool, kept: int) -> DataFrame:
    """``reps`` and ``probs`` of rows with a context's ``lead``."""

    def stays(x: Column) -> Column:
        first = (x["before"] == 0) | (x["own"] == F.col("token"))
        # The last of kept + 1 fillers counts only where the own token is one of those before it.
        inside = (x["rank"] <= kept) | F.exists("lead", lambda y: (y["token"] == F.col("token")) & (y["rank"] <= kept))
        return (x["token"] != F.col("token")) & first & inside & ((x["lemma"] != F.col("lemma")) | F.lit(not drop_query))

    found = F.slice(F.filter("lead", stays), 1, n)
    # A generator's rows are not computed again by a filter that is pushed below it.
    cut = joined.withColumn("reps", F.explode(F.filter(F.array(found), lambda r: F.size(r) > 0))).drop("lead")
    probs = let(F.aggregate("reps", F.lit(0.0), lambda s, x: s + x["cnt"]), lambda total: F.transform("reps", lambda x: x["cnt"] / total))
    return cut.withColumn("probs", probs).withColumn("reps", F.transform("reps", lambda x: x["lemma"]))


def by_context(index: DataFrame, parts: int) -> DataFrame:
    """The tokens of each context that has at least two: (prev, next, token, lemma, cnt, rank, found), as :func:`context_fillers` ranks them, all of them. Stored in ``parts`` buckets by context.

    ``index`` has ``sampled``; ``found`` holds the sampled occurrences' (file_id, pos), no more than the sample of a lemma. Occurrences are dealt by context this once: what reads the table finds a
    context's rows together. A lemma travels only where it is not the token.
    """
    other = F.when(F.col("lemma") != F.col("token"), F.col("lemma"))
    dealt = index.where("prev IS NOT NULL AND next IS NOT NULL").select("prev", "next", "token", other.alias("other"), F.when(F.col("sampled"), F.struct("file_id", "pos")).alias("at")).repartition(parts, "prev", "next")
    counted = dealt.groupBy("prev", "next", "token", "other").agg(F.count("*").alias("cnt"), F.collect_list("at").alias("found"))
    context = Window.partitionBy("prev", "next")
    ranked = counted.withColumn("rank", F.row_number().over(context.orderBy(F.desc("cnt"), "token")).cast("long")).withColumn("_n", F.count("*").over(context)).where("_n > 1")
    return bucketed(ranked.select("prev", "next", "token", F.coalesce("other", "token").alias("lemma"), "cnt", "rank", "found"), "contexts", parts, ["prev", "next"])


def by_token(contexts: DataFrame, n: int, drop_query: bool = True, sampled: bool = True, kept: int = KEPT) -> DataFrame:
    """What :func:`nearest` finds, once for each context and token of :func:`by_context`: (prev, next, token, lemma, found, times, reps, probs), as all occurrences of a token in a context have the same substitutes.

    ``times`` are the sampled occurrences; with ``sampled``, tokens without any are left out.
    """
    lead = leading(contexts.where(F.col("rank") <= kept + 1).select("prev", "next", "token", "lemma", "cnt", "rank"), n, dealt=True)
    asked = contexts.select("prev", "next", "token", "lemma", *([F.col("found"), F.size("found").cast("long").alias("times")] if sampled else []))
    return _chosen((asked.where("times > 0") if sampled else asked).join(lead, ["prev", "next"]), n, drop_query, kept)


def ranked_rows(contexts: DataFrame, kept: int = KEPT) -> DataFrame:
    """What :func:`substitutes` finds for the sampled occurrences of :func:`by_context`, one row per substitute: (lemma, file_id, pos, rank, token, prob), uncleaned, ``prob`` the share of all that are kept.

    Substitutes become rows once for each context and token, where a context's rows lie, and are repeated for its occurrences last. Ranks are consecutive in a context, so the own token's rank tells the
    places and the sum of the others.
    """
    first = contexts.where(F.col("rank") <= kept + 1)
    held = first.groupBy("prev", "next").agg(F.collect_list(F.struct("rank", "token", "cnt")).alias("all"), F.sum("cnt").alias("_sum"), F.sum(F.when(F.col("rank") <= kept, F.col("cnt"))).alias("_sum_kept"))
    asked = contexts.where(F.size("found") > 0).select("prev", "next", F.col("token").alias("own"), "lemma", F.col("cnt").alias("_cnt"), F.col("rank").alias("_rank"), "found")
    inside = F.col("_rank") <= kept
    rows = asked.join(held, ["prev", "next"]).select("lemma", "found", "own", "_rank", F.when(inside, F.col("_sum") - F.col("_cnt")).otherwise(F.col("_sum_kept")).alias("_total"), F.explode("all").alias("x"))
    place = F.col("x.rank") - F.when(F.col("x.rank") > F.col("_rank"), 1).otherwise(0)
    chosen = rows.where((F.col("x.rank") != F.col("_rank")) & (place <= kept)).select("lemma", "found", place.cast("long").alias("rank"), "x.token", (F.col("x.cnt") / F.col("_total")).alias("prob"))
    return chosen.select("lemma", F.explode("found").alias("o"), "rank", "token", "prob").select("lemma", "o.file_id", "o.pos", "rank", "token", "prob")


def flat(cleaned: DataFrame, keys: tuple[str, ...] = ("lemma", "file_id", "pos")) -> DataFrame:
    """One row per substitute: keys, rank (from 1), token, prob."""
    rows = cleaned.select(*keys, F.posexplode(F.arrays_zip("reps", "probs")).alias("rank", "x"))
    return rows.select(*keys, (F.col("rank") + 1).cast("long").alias("rank"), F.col("x.reps").alias("token"), F.col("x.probs").alias("prob"))
