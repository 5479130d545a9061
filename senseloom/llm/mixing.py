"""Mixing sources to target weights.

Tokens are summed by source and by the leading digits of a seeded hash of each document (partial aggregates: a hot source costs a few thousand rows per task), the
small table of sources gets its targets by closed-form water filling, and each document is emitted floor(rate) times plus once more with the fraction as
probability. The draw is systematic: a source's documents lie one after another in the order of their hashes, each as long as its size, and those whose
middle lies in the first ``fraction`` of the whole get the further copy. So a source's taken tokens miss the target by half a document at most,
however long documents are, and reruns and other partitionings give the same mix. Only the documents around the cut, one of 4,096 parts of each source, are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from senseloom.llm.common import materialize, maybe_broadcast, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 1


#: Leading hexadecimal digits of a draw by which sizes are summed.
DIGITS = 3


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """Fifteen hexadecimal digits from a hash of seed, id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(key), 1, 15)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of sources: rows (source, source_size) get ``target`` and ``rate``.

    Sources in code point order, null last, weigh ``weights`` in turn. They share ``share`` of all sizes by weight; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight, until none is above. Ordered by size over weight, the sources
    that stop form a prefix, so one pass of running sums finds the level. A source without words has target 0 and rate 1.
    The table has one row per source and is ordered in one task.
    """
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = sizes.withColumn("_nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("_w", F.element_at(cycle, (F.col("_nth") - 1) % len(weights) + 1).cast("long")).withColumn("_cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_nth").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    filled = weighed.withColumn("_level", level).withColumn("_stops", F.col("_w") * F.col("_level") > F.col("_cap"))
    final = F.max(F.when(~F.col("_stops"), F.col("_level"))).over(all_rows)
    filled = filled.withColumn("target", F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.col("_w") * final))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(1.0)
    return filled.select("source", "source_size", "target", rate.alias("rate"))


def cuts(docs: DataFrame, parts: DataFrame, rated: DataFrame) -> DataFrame:
    """Add ``cut`` to the sources in ``rated``: a document gets a further copy if its draw is at most that.

    ``docs`` has source, size and draw; ``parts`` has (source, part, part_size), sizes by the draw's first digits. In the part that holds the
    cut, documents are ordered by draw (those of one draw stand together); all parts before it are taken whole.
    """
    wanted = ((F.col("rate") - F.floor("rate")) * F.col("source_size")).alias("wanted")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(maybe_broadcast(rated.select(F.col("source").alias("_source"), wanted)), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_before", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    edge = placed.where((F.col("wanted") > 0) & (F.col("_before") <= F.col("wanted")) & (F.col("wanted") < F.col("_before") + F.col("part_size"))).select("_source", "part", "_before", "wanted")
    edge = materialize(edge, "edge")
    near = docs.join(maybe_broadcast(edge), F.col("source").eqNullSafe(F.col("_source")) & (F.substring("draw", 1, DIGITS) == F.col("part")))
    near = near.groupBy("_source", "draw").agg(F.sum("size").alias("n"), F.first("_before").alias("_before"), F.first("wanted").alias("wanted"))
    so_far = F.col("_before") + F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = near.withColumn("_middle", 2 * so_far + F.col("n")).where(F.col("_middle") <= 2 * F.col("wanted")).groupBy("_source").agg(F.max("draw").alias("cut"))
    # Without a document before the cut in its part, the cut lies before the part; without a part that holds it, all or none are taken.
    held = edge.select(F.col("_source").alias("_edge"), "part").join(taken, F.col("_edge").eqNullSafe(F.col("_source")), "left").select("_edge", F.coalesce("cut", "part").alias("_cut"))
    whole = F.when(F.col("rate") > F.floor("rate"), "g").otherwise("")
    return rated.join(held, F.col("source").eqNullSafe(F.col("_edge")), "left").withColumn("cut", F.coalesce("_cut", whole)).drop("_edge", "_cut")


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """(row, size, source_size, target, rate, copies): each document as one struct, so that no name of its columns meets one of ours."""
    drawn = docs.select("source", word_count(F.col("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("draw"))
    parts = materialize(drawn.groupBy("source", F.substring("draw", 1, DIGITS).alias("part")).agg(F.sum("size").alias("part_size")), "parts")
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    rated = materialize(targets(sizes, weights, share, most), "rates")
    found = materialize(cuts(drawn, parts, rated), "cuts").select(F.col("source").alias("of"), "source_size", "target", "rate", "cut")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    held = docs.select(row, F.col("source").alias("source"), word_count(F.col("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("draw"))
    joined = held.join(maybe_broadcast(found), F.col("source").eqNullSafe(F.col("of")), "left")
    copies = F.floor("rate").cast("int") + (F.col("draw") <= F.col("cut")).cast("int")
    return joined.select("row", "size", "source_size", "target", "rate", copies.alias("copies"))


def plan_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Add ``size`` (words), ``source_size``, ``target``, ``rate`` and ``copies`` to every document.

    ``docs`` has doc_id, text and source. A null or empty text has size 0; a null id is one like any other; null is a source of its own, the last in order. Rows
    alike in id and text share a draw and get the same number of copies each. An empty table gives an empty one. Columns of the added names are
    replaced, names that differ in case only included; other columns are kept, whatever their names.
    """
    added = ("size", "source_size", "target", "rate", "copies")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in added))
    return _planned(kept, weights, share, most, seed).select("row.*", *added)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Emit each document as often as :func:`plan_copies` says, with the columns of ``docs``, all of them, whatever their names."""
    return _planned(docs, weights, share, most, seed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


PLAN_SQL = r"""
WITH docs AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5(concat('1:', coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))), 1, 15) AS draw FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((nth - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM weighed WINDOW before AS (ORDER BY cap::DOUBLE / w::DOUBLE, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, CASE WHEN w * level > cap THEN cap::DOUBLE ELSE w * max(CASE WHEN NOT w * level > cap THEN level END) OVER () END AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 1.0::DOUBLE END AS rate FROM filled),
placed AS (SELECT d.doc_id, d.size, r.source_size, r.target, floor(r.rate)::INT AS whole, (r.rate - floor(r.rate)) * r.source_size AS wanted,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw RANGE UNBOUNDED PRECEDING) AS after, sum(d.size) OVER (PARTITION BY d.source, d.draw) AS n
  FROM docs d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN wanted > 0 AND 2 * after - n <= 2 * wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""
