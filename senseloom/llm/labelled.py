"""Labelled training samples of bounded size for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, seed: int) -> tuple[list[str], list[float]]:
    """Texts and labels (0 or 1) of at most ``per_class`` documents of either class, chosen by a seeded hash of their ids.

    ``labels`` has doc_id and ``label``; null ids and labels are skipped, an id with several labels counts as 1 if their mean is at
    least 0.5. Ids are chosen from the narrow table of labels, so of the documents only the chosen ones move; chosen documents of more than ``max_chars``
    characters are left out, and the driver holds 2 * per_class * max_chars characters at most.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("_label"))
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    chosen = known.where("_label = 0").orderBy(*order).limit(per_class).union(known.where("_label = 1").orderBy(*order).limit(per_class))
    short = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    rows = short.join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(2 * per_class).collect()  # the limit holds if ids repeat
    return [r["text"] or "" for r in rows], [r["_label"] for r in rows]
