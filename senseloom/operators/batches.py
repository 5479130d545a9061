"""Length-bucketed batches for a model that pads: items of like length share a batch of bounded padded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from senseloom.functions.storage import stored

SEED = 111
NOISE = 0.1
MAX_TOKENS = 16_384
#: Items that are cut into batches in one task.
RANGE_ROWS = 50_000
#: Leading digits of an item's hash, at most, by which items of one noisy length are told apart.
DIGITS = 6
#: A table of at most so many rows is broadcast.
SMALL = 200_000


def noisy_length(size: Column, digest: Column, noise: float = NOISE) -> Column:
    """The size changed by up to ``noise`` of itself either way, as the first digits of ``digest`` (hexadecimal) say, in whole tokens."""
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.floor(size + size * noise * (2 * u - 1)).cast("long")


def cut(sizes: np.ndarray, max_tokens: int) -> np.ndarray:
    """Batch of each item in order: a new one where the longest length times the number of items would exceed ``max_tokens``. No batch is empty; a longer item stands alone."""
    out, batch, n, longest = np.zeros(len(sizes), np.int64), 0, 0, 0
    for i, size in enumerate(sizes.tolist()):
        if n and max(longest, size) * (n + 1) > max_tokens:
            batch, n, longest = batch + 1, 0, 0
        n, longest = n + 1, max(longest, size)
        out[i] = batch
    return out


def length_batches(items: DataFrame, key: str, size: Column, max_tokens: int = MAX_TOKENS, noise: float = NOISE, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Batches of items of like length: (key, size, noisy, batch, place, turn).

    Items are ordered by noisy length, those of one noisy length by a seeded hash of the key (rows of one key by size), and cut greedily into batches with max(size) * n <= ``max_tokens``. The order is dealt to
    tasks in ranges of about ``range_rows`` items: neighbouring lengths share a range, and a length that more items have is divided by the first digits of their hashes. Ranges follow from the
    counts alone, so the batches are the same on any cluster. Batches are numbered from 0 without gaps in that order; ``turn`` is a seeded hash by which batches come in random order. A null size
    counts as 0; an empty table gives an empty one.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = items.select(F.col(key).alias("item"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), digest.alias("digest"))
    placed = sized.withColumn("noisy", noisy_length(F.col("size"), F.col("digest"), noise))
    # One row per noisy length; lengths are bounded by the longest item.
    counts = stored(placed.groupBy("noisy").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.orderBy("noisy").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    digits = F.least(F.lit(DIGITS), F.ceil(F.log2(F.col("n") / range_rows) / 4)).cast("int")
    ranges = counts.select(F.col("noisy").alias("of"), F.floor(before / range_rows).alias("range"), F.when(F.col("n") > range_rows, digits).otherwise(0).alias("digits"))
    # A divided length has parts of its own after the shorter ones of its range; the next longer one is in a later range.
    first = F.when(F.col("digits") > 0, F.col("of")).otherwise(F.lit(-1))
    dealt = placed.join(F.broadcast(ranges) if counts.count() <= SMALL else ranges, F.col("noisy") == F.col("of"))
    keys = ["range", "first", "part"]
    tags = dealt.withColumn("first", first).withColumn("part", F.substring("digest", F.lit(1), F.col("digits"))).select("item", "size", "noisy", "digest", *keys)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("noisy", "ascending"), ("digest", "ascending"), ("size", "ascending")])
        local = cut(group.column("size").to_numpy(), max_tokens)
        starts = np.searchsorted(local, local)
        return group.drop_columns(["digest"]).append_column("local", pa.array(local)).append_column("place", pa.array(np.arange(len(local)) - starts))

    kind = items.schema[key].dataType.simpleString()
    packed = stored(tags.groupBy(*keys).applyInArrow(pack, f"item {kind}, size long, noisy long, range long, first long, part string, local long, place long"), "batches")
    # One row per range.
    made = packed.groupBy(*keys).agg((F.max("local") + 1).alias("n"))
    order = Window.orderBy("range", "first", "part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = stored(made.withColumn("offset", F.sum("n").over(order) - F.col("n")).drop("n"), "offsets")
    numbered = packed.join(F.broadcast(offsets) if offsets.count() <= SMALL else offsets, keys)
    batch = F.col("offset") + F.col("local")
    turn = F.md5(F.concat(F.lit(f"{seed}:"), batch.cast("string")))
    return numbered.select(F.col("item").alias(key), "size", "noisy", batch.alias("batch"), "place", turn.alias("turn"))
