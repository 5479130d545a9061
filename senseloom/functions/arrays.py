"""Column functions over arrays that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed."""
    return F.transform(F.array(value), body)[0]


def first_of_each(items: Column, key: str) -> Column:
    """Keep the first struct of each value of its field ``key``, in order."""
    return let(F.transform(items, lambda x: x[key]), lambda keys: F.filter(items, lambda x, i: F.array_position(keys, x[key]) == i + 1))


def jaccard_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of intersection and union of two duplicate-free arrays."""
    shared = F.size(F.array_intersect(a, b))
    return shared, F.size(a) + F.size(b) - shared


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; null for two empty ones."""
    shared, union = jaccard_parts(a, b)
    return F.when(union > 0, shared / union)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of double, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def two_decimals(x: Column) -> Column:
    """A number from 0 to 1 rounded to two decimals as its binary value says, ties to the even digit; as text (0.12, 0.50, 1.00)."""
    whole = (x * float(1 << 60)).cast("long").cast("decimal(38,0)") * 100  # exact: a double has 53 bits
    q = F.floor(whole / F.lit(1 << 60).cast("decimal(38,0)")).cast("decimal(38,0)")
    rest, half = whole - q * F.lit(1 << 60).cast("decimal(38,0)"), F.lit(1 << 59).cast("decimal(38,0)")
    up = (rest > half) | ((rest == half) & (q % 2 == 1))
    digits = (q + F.when(up, 1).otherwise(0)).cast("long")
    return F.concat(F.floor(digits / 100).cast("string"), F.lit("."), F.lpad((digits % 100).cast("string"), 2, "0"))


def pack_starts(sizes: Column, cap: int) -> Column:
    """Places (from 0) at which packs start when consecutive items share a pack up to ``cap``; an oversize item has a pack of its own.

    A pack closes when it holds an item and the next one would exceed the cap, so items of size zero before an oversize one form a pack too. The list grows by pack, not by item.
    """
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("total"))

    def step(state: Column, size: Column) -> Column:
        new = (state["at"] == 0) | (state["total"] + size > cap)
        starts = F.when(new, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"])
        return F.struct(starts.alias("starts"), (state["at"] + 1).alias("at"), F.when(new, size).otherwise(state["total"] + size).cast("long").alias("total"))

    return F.aggregate(sizes, start, step, lambda s: s["starts"])


def packs_of(items: Column, starts: Column) -> Column:
    """The items of each pack, as an array of arrays."""
    return F.transform(starts, lambda s, i: F.slice(items, s + 1, F.coalesce(F.get(starts, i + 1), F.size(items)) - s))


def greedy_packs(sizes: Column, cap: int) -> Column:
    """Pack number of each item; see :func:`pack_starts` for the rule."""
    return let(pack_starts(sizes, cap), lambda starts: F.flatten(F.transform(packs_of(sizes, starts), lambda p, i: F.array_repeat(i, F.size(p)))))
