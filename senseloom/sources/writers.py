"""Writers of stage tables and of text results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lemma_pos(inst_id: str = "inst_id"):
    """lemma.pos of an instance id lemma.pos.n."""
    return F.regexp_extract(inst_id, r"^(.*)\.[^.]*$", 1)


def hard_key_lines(labels: DataFrame) -> DataFrame:
    """Lines `lemma.pos inst_id label` from (inst_id, label)."""
    return labels.select(F.concat_ws(" ", lemma_pos(), "inst_id", F.col("label").cast("string")).alias("value"))


def soft_key_lines(labels: DataFrame) -> DataFrame:
    """Lines `lemma.pos inst_id c/n ...`, least n first, from (inst_id, labels: map of label to count)."""
    items = F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("c"))))
    return labels.select(F.concat_ws(" ", lemma_pos(), "inst_id", F.array_join(F.transform(items, lambda x: F.concat(x["c"].cast("string"), F.lit("/"), x["n"].cast("string"))), " ")).alias("value"))


def write_lines(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Write a column ``value`` as text files; with ``order`` they are range-partitioned, so part files follow each other in that order."""
    if order:
        rows = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    rows.select("value").write.text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """T or F per line in the order of items, from (item, same)."""
    write_lines(predictions.select("item", F.when(F.col("same"), "T").otherwise("F").alias("value")), path, "item")


def write_inventory(inventory: DataFrame, path: str, method: str, n_reps: int) -> None:
    """Store a sense inventory under its method and number of substitutes; another run's is left alone."""
    if method not in ("community_detection", "agglomerative_clustering"):
        raise ValueError(f"unknown method {method}")
    inventory.withColumns({"method": F.lit(method), "n_reps": F.lit(n_reps)}).write.mode("append").partitionBy("method", "n_reps").parquet(path)


def write_tagged(tokens: DataFrame, path: str) -> None:
    """Store positional tables sorted by file and position, so that a look-up of a file reads few row groups."""
    tokens.repartitionByRange("file_id").sortWithinPartitions("file_id", "pos").write.parquet(path)
