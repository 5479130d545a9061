"""Links between similar senses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from senseloom.functions.arrays import jaccard_parts
from senseloom.functions.storage import stored
from senseloom.operators.senses import sense_sets

SIGNATURE = 10
KEPT = 11
SHOWN = 0.1
#: Sets that are broadcast at once, each with its elements one by one (about 100 MB).
SLICE = 50_000


def signatures(inventory: DataFrame, size: int = SIGNATURE) -> DataFrame:
    """(lemma, sense_id, tokens): the lemma and a sense's first ``size`` tokens."""
    return sense_sets(inventory).select("lemma", "sense_id", F.array_distinct(F.concat(F.array("lemma"), F.slice("tokens", 1, size))).alias("tokens"))


def name(lemma: str = "lemma", sense_id: str = "sense_id"):
    return F.concat(F.col(lemma), F.lit("_"), F.col(sense_id).cast("string"))


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """Add ``id``, a number that follows the given order; ranges of the order are sorted each on its own."""
    return rows.orderBy(*order).withColumn("id", F.monotonically_increasing_id())


def _compared(pairs: DataFrame, common: str = "common") -> DataFrame:
    """Add shared, total and score to pairs of sets (set, other_set), whose common elements are given."""
    shared = F.size(common).cast("long")
    counted = pairs.withColumn("shared", shared).withColumn("total", F.size("set") + F.size("other_set") - F.col("shared"))
    return counted.withColumn("score", F.col("shared") / F.col("total"))


def _first(pairs: DataFrame, kept: int) -> DataFrame:
    """The ``kept`` best of each set by score, then by the larger other: with ``rank``."""
    order = Window.partitionBy("of").orderBy(F.desc("score"), F.desc("other"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def candidates_by_heads(sets: DataFrame, kept: int) -> DataFrame:
    """Pairs of sets that meet in the head of a posting list of an element or of a pair of elements; ``sets`` has of and set (sorted).

    A list's head are its ``kept`` + 1 first sets by size, then the largest number. All sets before another in a list that has no more in common with the asking set than the list's key
    are at least as similar to it, so the heads hold every neighbour that shares one or two elements.
    """
    single = F.transform("set", lambda x: F.struct(x.alias("a"), x.alias("b")))
    double = F.flatten(F.transform("set", lambda x, i: F.transform(F.slice("set", i + 2, F.size("set")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    keys = sets.select("of", "set", F.explode(F.concat(single, double)).alias("key")).select("of", "set", "key.a", "key.b")
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.size("set"), F.desc("of")))
    heads = keys.withColumn("_nth", place).where(F.col("_nth") <= kept + 1).select("a", "b", F.col("of").alias("other"), F.col("set").alias("other_set"))
    # Keys are many times the stored sets that they are made of, whose size alone would let them be broadcast.
    return keys.hint("merge").join(heads, ["a", "b"]).where("of <> other").withColumn("common", F.array_intersect("set", "other_set"))


def candidates_by_prefix(sets: DataFrame, floors: DataFrame, most: int, least: int = 3, others: DataFrame | None = None) -> DataFrame:
    """Pairs of sets with at least ``least`` elements in common that may come before the asking set's last neighbour so far (of, floor: its score, and last: the neighbour, if known); ``others`` are looked at, by default all.

    Elements are numbered from rare to frequent. For a floor t, sets of n and m elements need t / (1 + t) * (n + m) in common, which bounds the place of the first common
    element in either set; so an asking set looks, for each element of its prefix, for the sets that hold it at a possible place. Size and place are part of the join's key: no pair beyond the
    bounds is made, and a frequent element, which stands last, has no hot key. At the last of these places no more than the floor can be reached, which is enough for larger others than ``last`` alone. A pair counts at
    its first common element alone.
    """
    floors = floors if "last" in floors.columns else floors.withColumn("last", F.lit(None).cast("long"))
    asked = sets.join(floors, "of", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    n, share = F.size("set"), F.col("floor") / (1 + F.col("floor"))

    def of_size(i: Column, m: Column) -> Column:
        need = F.greatest(F.lit(least), F.ceil(share * (n + m) - 1e-9).cast("int"))
        more = F.greatest(F.lit(least), F.floor(share * (n + m) + 1e-9).cast("int") + 1)
        places = F.transform(F.sequence(F.lit(0), F.greatest(m - need, F.lit(0))), lambda at: F.struct(F.get("set", i).alias("element"), m.alias("size"), at.alias("at"), ((more > n - i) | (more > m - at)).alias("equal")))
        return F.filter(places, lambda x: (need <= n - i) & (need <= m))

    sizes = F.sequence(F.lit(least), F.lit(max(least, most)))
    probes = asked.withColumn("p", F.explode(F.flatten(F.transform("set", lambda _, i: F.flatten(F.transform(sizes, lambda m: of_size(i, m))))))).select("of", "set", "floor", "last", "p.*")
    held = (sets if others is None else others).select(F.col("of").alias("other"), F.col("set").alias("other_set"), F.size("set").alias("size"), F.posexplode("set").alias("at", "element"))
    held = held if others is None else F.broadcast(held)
    late = ~F.col("equal") | F.coalesce(F.col("other") > F.col("last"), F.lit(True))
    met = probes.join(held, ["element", "size", "at"]).where((F.col("of") != F.col("other")) & late).withColumn("common", F.array_intersect("set", "other_set"))
    return met.where((F.size("common") >= least) & (F.get("common", F.lit(0)) == F.col("element")))


def closest_sets(sets: DataFrame, kept: int = KEPT, sliced: int = SLICE) -> DataFrame:
    """The ``kept`` most similar other sets of each distinct set that share an element: (of, other, shared, total, score, rank).

    The heads of posting lists give neighbours and a floor for the rest; the prefix filter finds what else may exceed it, or equal it by a larger other. Every candidate is compared exactly. What is asked does not travel: the
    sets to look at are broadcast, ``sliced`` of them at a time, whatever their number.
    """
    columns = ("of", "other", "shared", "total", "score")
    near = stored(_first(_compared(candidates_by_heads(sets, kept)).select(*columns).dropDuplicates(["of", "other"]), kept), "near")
    floors = near.where(F.col("rank") == kept).select("of", F.col("score").alias("floor"), F.col("other").alias("last"))
    n, most = sets.agg(F.count("*"), F.max(F.size("set"))).first()
    asked = sets.repartition(4 * sets.sparkSession.sparkContext.defaultParallelism, "of")  # a set's work is much larger than the set
    found, slices = near.select(*columns), max(1, -(-n // sliced))
    for k in range(slices):
        more = _compared(candidates_by_prefix(asked, floors, most or 0, others=sets.where(F.pmod(F.xxhash64("of"), F.lit(slices)) == k)))
        better = (F.col("score") > F.col("floor")) | ((F.col("score") == F.col("floor")) & F.coalesce(F.col("other") > F.col("last"), F.lit(True)))
        found = found.union(stored(_first(more.where(better).select(*columns), kept).select(*columns), "more"))
    return _first(found.dropDuplicates(["of", "other"]), kept)


def closest(signatures: DataFrame, kept: int = KEPT) -> DataFrame:
    """The ``kept`` most similar other senses of each sense by Jaccard: (sense, neighbour, shared, total, score, rank).

    Equal scores go by name, descending. Senses with the same tokens are one set, named by the last of them; of a set only its last names can be neighbours. Sets are compared by
    :func:`closest_sets`. A sense with too few neighbours is filled up with the last names of no overlap: the same last names serve all.
    """
    # Numbers in the order of the names stand for them until the links are chosen; tokens are numbered from rare to frequent.
    named = stored(_numbered(signatures.select(name().alias("sense"), "tokens", F.size("tokens").cast("long").alias("size")), "sense"), "signatures")
    tokens = named.select(F.col("id").alias("member"), F.explode("tokens").alias("token"))
    rare = stored(_numbered(tokens.groupBy("token").agg(F.count("*").alias("n")), "n", "token"), "elements")
    members = stored(tokens.join(rare, "token").groupBy("member").agg(F.sort_array(F.collect_list("id")).alias("set")), "members")
    sets = stored(members.groupBy("set").agg(F.max("member").alias("of"), F.count("*").alias("copies")), "sets")
    pairs = closest_sets(sets.select("of", "set"), kept).select("of", "other", "shared", "total")
    size = F.size("set").cast("long")
    pairs = pairs.union(sets.where("copies > 1").select("of", F.col("of").alias("other"), size, size))
    placed = members.join(sets.select("set", "of"), "set").select("of", F.col("member").alias("id"))
    last = placed.withColumn("_nth", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("id")))).where(F.col("_nth") <= kept + 1).select(F.col("of").alias("other"), F.col("id").alias("other_id"))
    met = placed.join(pairs, "of").join(last, "other").where("id <> other_id").select("id", F.col("other_id").alias("other"), "shared", "total")
    order = Window.partitionBy("id").orderBy(F.desc(F.col("shared") / F.col("total")), F.desc("other"))
    best = stored(met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept).drop("rank"), "met")
    # Senses that met too few are filled up with the last names in order: enough for any sense, itself and its own neighbours taken out.
    sizes = named.select("id", "size")
    last_names = named.orderBy(F.desc("id")).limit(2 * kept + 1).select(F.col("id").alias("other"), F.col("size").alias("other_size"))
    few = sizes.join(best.groupBy("id").agg(F.count("*").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) < kept).select("id", "size")
    filler = few.crossJoin(F.broadcast(last_names)).where("id <> other").join(best.select("id", "other").hint("merge"), ["id", "other"], "left_anti")
    everyone = best.union(filler.select("id", "other", F.lit(0).cast("long"), F.col("size") + F.col("other_size")))
    ranked = everyone.withColumn("score", F.col("shared") / F.col("total")).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept)
    names = named.select("id", "sense")
    return ranked.join(names, "id").join(names.select(F.col("id").alias("other"), F.col("sense").alias("neighbour")), "other").select("sense", "neighbour", "shared", "total", "score", "rank")


def expand(links: DataFrame, start: DataFrame, least: float = SHOWN, most_rounds: int | None = None) -> DataFrame:
    """All senses reachable from ``start`` (sense) along links with a score above ``least``: (sense, depth), start at depth 0.

    A frontier is joined with the links in each round and what was seen is left out; each round is stored in the shared folder. Rounds end when nothing new is
    reached; a ``most_rounds`` that is too small for that raises an error.
    """
    near = stored(links.where(F.col("score") > least).select("sense", "neighbour"), "near")
    seen = new = stored(start.select("sense").distinct().withColumn("depth", F.lit(0).cast("long")), "reached")
    depth = 0
    while not new.isEmpty():
        depth += 1
        if most_rounds is not None and depth > most_rounds:
            raise RuntimeError(f"senses are still being reached after {most_rounds} rounds")
        found = new.join(near, "sense").select(F.col("neighbour").alias("sense")).distinct().join(seen, "sense", "left_anti")
        new = stored(found.withColumn("depth", F.lit(depth).cast("long")), "reached")
        seen = stored(seen.union(new), "seen")
    return seen


def infer_by_list(inventory: DataFrame, words: list[str], size: int = SIGNATURE) -> DataFrame:
    """Pick one sense of each of a few words so that the mean Jaccard similarity of all pairs is greatest.

    Returns every choice as (senses, shared, total, score), best first by score then senses; the score is the sum over pairs of shared over total tokens. The number of choices is the product of
    the words' numbers of senses; the similarity of two senses is computed once, over the senses of the listed words alone.
    """
    sets = signatures(inventory, size).where(F.col("lemma").isin(*words))
    choice = None
    for i, word in enumerate(words):
        one = sets.where(F.col("lemma") == word).select(F.col("sense_id").alias(f"s{i}"), F.col("tokens").alias(f"t{i}"))
        choice = one if choice is None else choice.crossJoin(F.broadcast(one))
    parts = [jaccard_parts(F.col(f"t{i}"), F.col(f"t{j}")) for i in range(len(words)) for j in range(i)]
    score = reduce(lambda a, b: a + b, [a / b for a, b in parts], F.lit(0.0))
    names = F.concat_ws(" ", *(F.concat(F.lit(f"{w}_"), F.col(f"s{i}").cast("string")) for i, w in enumerate(words)))
    return choice.select(names.alias("senses"), score.alias("score"))


def infer_greedily(inventory: DataFrame, words: list[str], size: int = SIGNATURE, beam: int = 50) -> DataFrame:
    """The same choice for longer lists: groups of senses grow word by word, best first, and the ``beam`` best groups of each length are kept: (senses, score).

    Words go in the given order; a group's score is that of :func:`infer_by_list`, and equal ones go by the names of their senses. Each step compares at most ``beam`` groups with the senses of one
    word, so a list of ten words ends however many senses they have. With a beam as large as the number of all choices the result is exact. A word without senses is left out; no word at all gives no
    row.
    """
    sets = stored(signatures(inventory, size).where(F.col("lemma").isin(*words)).coalesce(1), "listed")  # the senses of the listed words
    known = {r["lemma"] for r in sets.select("lemma").distinct().collect()}
    groups = None
    for word in (w for w in dict.fromkeys(words) if w in known):
        one = sets.where(F.col("lemma") == word).select(F.concat(F.lit(f"{word}_"), F.col("sense_id").cast("string")).alias("sense"), F.col("tokens").alias("new"))
        if groups is None:
            grown = one.select(F.col("sense").alias("senses"), F.array("new").alias("chosen"), F.lit(0.0).alias("score"))
        else:

            def similar(t: Column) -> Column:
                shared, union = jaccard_parts(F.col("new"), t)
                return shared / union

            gain = F.aggregate("chosen", F.lit(0.0), lambda s, t: s + similar(t))
            grown = groups.crossJoin(F.broadcast(one)).select(F.concat_ws(" ", "senses", "sense").alias("senses"), F.concat("chosen", F.array("new")).alias("chosen"), (F.col("score") + gain).alias("score"))
        # At most ``beam`` rows go on.
        groups = grown.orderBy(F.desc(F.round("score", 9)), "senses").limit(beam)
    if groups is None:
        return sets.select(F.lit("").alias("senses"), F.lit(0.0).alias("score")).limit(0)
    return groups.select("senses", "score")


def store_links(links: DataFrame, path: str) -> None:
    """The nearest senses of each sense as text, in folders by first letter: sense, then neighbour and score in rank order, tab-separated."""
    line = F.concat_ws("\t", "sense", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "score"))), lambda x: F.concat_ws("\t", x["neighbour"], x["score"].cast("string"))), "\t"))
    rows = links.groupBy("sense").agg(line.alias("value")).select("value", F.substring("sense", 1, 1).alias("letter"))
    rows.write.mode("overwrite").partitionBy("letter").text(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(sense, neighbour, score, rank) of links that :func:`store_links` wrote."""
    parts = F.split("value", "\t")
    pair = F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), lambda i: F.struct(i.cast("long").alias("rank"), F.get(parts, 2 * i - 1).alias("neighbour"), F.get(parts, 2 * i).cast("double").alias("score")))
    return spark.read.text(path).select(parts[0].alias("sense"), F.explode(pair).alias("p")).select("sense", "p.neighbour", "p.score", "p.rank")
