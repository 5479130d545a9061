"""Document fingerprints by winnowing, in built-in functions only.

Each ``k`` characters in a row are a gram, at every place of a text, spaces or not. A gram's hash is the Karp-Rabin polynomial of its code points; array functions keep no
running state, so hashes roll by doubling: that of 2 m characters follows from two of m by one multiplication, log k steps for all places together, and no gram is hashed anew.
In each window of ``w`` hashes the least is chosen, of equal ones the rightmost, and kept with its position. Any shared passage of at least ``w + k - 1`` characters
thus shares a chosen hash, wherever it stands. A choice is one long: the hash above the position counted backwards, so ``least`` prefers the rightmost of equal hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from senseloom.llm.common import materialize, maybe_broadcast

K = 16
W = 32
#: Hashes are polynomials modulo a prime of 31 bits, at this base.
PRIME = (1 << 31) - 1
BASE = 911_382_323
LAST = (1 << 31) - 1

#: Bytes of text in one bucket of neighbours, and the most ranges of ids.
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 16
CHUNK_ROWS = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.transform(F.array(value), body)[0]


def windows_least(hashes: Column, w: int) -> Column:
    """Least of each window, by windows of doubled width; the ends where fewer follow are cut off. Equal ones stand next to each other: the last of them stays."""

    def widen(m: Column, width: int) -> Column:
        if width == w:
            return let(F.slice(m, F.lit(1), F.greatest(F.lit(1), F.size(m) - (w - 1))), lambda x: F.filter(x, lambda v, i: ~v.eqNullSafe(F.get(x, i + 1))))
        by = min(width, w - width)
        return let(F.transform(m, lambda a, i: F.least(a, F.get(m, i + by))), lambda x: widen(x, width + by))

    return widen(hashes, 1)


def rolled(codes: Column, k: int, keep: Callable[[Column, Column], Column]) -> Column:
    """``keep`` of the hash of ``k`` codes and its place, for each place that ``k`` codes follow."""

    def roll(width: int, then: Callable[[Column], Column], keep: Callable[[Column, Column], Column]) -> Column:
        """The hash of ``width`` codes from that of the first of them and of the last ``by``: by halves, of an odd number by one code more."""
        if width == 1:
            return then(F.transform(codes, keep) if k == 1 else codes)
        by = 1 if width % 2 else width // 2
        pair = lambda a, b: (a * F.lit(pow(BASE, by, PRIME)) + b) % F.lit(PRIME)
        return roll(width - by, lambda h: let(F.transform(h, lambda a, i: keep(pair(a, F.get(codes if by == 1 else h, i + (width - by))), i)), then), lambda h, i: h)

    return roll(k, lambda h: F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(codes) - (k - 1))), keep)


def choices(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen hashes of a text with their positions (code points, from 0), in text order; of a null or empty text an empty array.

    A text of fewer than ``k`` characters is one hash; of fewer than ``w`` hashes the least is chosen.
    """

    def pack(h: Column, at: Column) -> Column:
        return F.shiftleft(h, 31).bitwiseOR(LAST - at)

    def chosen(codes: Column) -> Column:
        short = F.array(pack(F.aggregate(codes, F.lit(1).cast("long"), lambda h, c: (h * F.lit(BASE) + c) % F.lit(PRIME)), F.lit(0)))
        grams = let(rolled(codes, k, pack), lambda h: windows_least(h, w))
        return F.when(F.size(codes) >= k, grams).otherwise(short)

    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.when(F.char_length(text) > 0, let(codes, chosen)).otherwise(F.array().cast("array<long>"))


def place_of(choice: Column) -> Column:
    return LAST - choice.bitwiseAND(LAST)


def first_windows(chosen: Column, last: Column, w: int) -> Column:
    """The choices of the windows that start at ``last`` or before: places only grow from window to window, so these are all up to the choice of that window."""
    edge = place_of(F.array_min(F.filter(chosen, lambda v: place_of(v).between(last, last + (w - 1)))))
    return let(edge, lambda e: F.filter(chosen, lambda v: place_of(v) <= e))


def edited_choices(chosen: Column, next_chosen: Column, edited: Column, cut: Column, k: int, w: int) -> Column:
    """The choices of a text whose first ``cut`` characters are one document's and whose others are the first ones of the next.

    Windows that lie in one of the two parts are those of that document, so only the text around the cut is fingerprinted anew. If the first part has no whole window, all of it is.
    """
    span = k + w - 1
    none = F.array().cast("array<long>")

    def joined(last: Column) -> Column:
        around = F.substring(edited, before + 2, F.least(cut, last + 1) + (span - 2) - before)
        return F.concat(
            first_windows(chosen, before, w),
            F.when(last > before, let(choices(around, k, w), lambda x: F.transform(x, lambda v: v - (before + 1)))).otherwise(none),
            F.when(last >= cut, F.transform(first_windows(next_chosen, last - cut, w), lambda v: v - cut)).otherwise(none),
        )

    before = cut - span  # the last start of a window before the cut; of all windows it is ``last``, which is counted once
    return F.when(before < 0, choices(edited, k, w)).otherwise(F.array_distinct(let(F.char_length(edited) - span, joined)))


def hash_set(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, 31)))


def as_text(chosen: Column) -> Column:
    """hash@position, comma-joined."""
    return F.lower(F.array_join(F.transform(chosen, lambda v: F.concat(F.hex(F.shiftright(v, 31)), F.lit("@"), (LAST - v.bitwiseAND(LAST)).cast("string"))), ","))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sets; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return let(shared, lambda s: F.when(F.size(a) + F.size(b) > 0, s / (F.size(a) + F.size(b) - s)).otherwise(1.0))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Add ``fingerprint`` (hash@position, comma-joined) to every row; equal texts have equal ones, null and empty texts the empty one."""
    return docs.withColumn("fingerprint", as_text(choices(F.col("text"), k, w)))


def ranges(docs: DataFrame, key: str, buckets: int) -> list[tuple[int, int, int]]:
    """Ranges of ids of about equal numbers of rows: (first id, first bucket, buckets of that id alone), sorted.

    An id that fills several ranges gets as many buckets of its own, which its rows share by their hashes; the range's other ids get the one after.
    """
    if buckets < 2:
        return [(-(1 << 63), 0, 0)]
    cuts = docs.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    out, at = [(-(1 << 63), 0, 0)], 1
    for first, repeats in groupby(sorted(cuts)):
        own = len(list(repeats))
        own = own if own > 1 else 0
        out = [x for x in out if x[0] != first] + [(first, at, own)]
        at += own + 1
    return out


def with_next(docs: DataFrame, extra: dict[str, Column], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (doc_id, text, ``extra``, next: struct of text and ``extra``) where next is the next document by doc_id, of the last the first.

    Null ids come first; documents of one id are ordered by a hash of their text, and rows alike follow each other. Documents are dealt into ranges of ids, and of
    hashes where an id is frequent; the first document of each range is also sent to the range before it, so no task needs more than its range. Of
    very many rows alike one travels and the others are made anew: each is followed by another one of them.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    buckets = int(max(1, min(MOST_BUCKETS, total["n"], -(-total["bytes"] // bucket_bytes))))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select("doc_id", "text", key.alias("_key"), F.xxhash64("text").alias("_hash"))
    many = keyed.groupBy("_key", "_hash").agg(F.count("*").alias("_many"), F.max(F.octet_length("text")).alias("_size")).where((F.col("_many") > CHUNK_ROWS) & (F.col("_many") * F.col("_size") > bucket_bytes // 8))
    many = materialize(many.select("_key", "_hash", "_many"), "alike")
    copies = None
    if held := many.count():
        small = maybe_broadcast(many, held)
        one = keyed.join(small, ["_key", "_hash"]).groupBy("_key", "_hash", "doc_id", "text").agg(F.first("_many").alias("_many"))
        chunks = one.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_many") - 1, F.lit(CHUNK_ROWS).cast("long")))).repartition("_key", "_hash", "_from")
        copies = chunks.withColumn("_nth", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK_ROWS, "_many") - 1))).select("doc_id", "text")
        keyed = keyed.join(small, ["_key", "_hash"], "left_anti").select("doc_id", "text", "_key", "_hash").unionByName(one.select("doc_id", "text", "_key", "_hash"))
    found = ranges(keyed.select("_key"), "_key", buckets)
    # Place among the ranges in two steps: among every step-th first id (literals), then in that step's ranges (a small table).
    step = max(1, int(len(found) ** 0.5))
    steps = [found[i : i + step] for i in range(0, len(found), step)]
    coarse = F.size(F.filter(F.array(*(F.lit(x[0][0]) for x in steps)), lambda b: b <= F.col("_key"))) - 1
    fine = F.broadcast(spark.createDataFrame(list(enumerate(steps)), "_step int, _ranges array<struct<first:long,at:int,own:int>>"))
    held = F.element_at(F.filter("_ranges", lambda x: x["first"] <= F.col("_key")), -1)
    part = F.shiftright((F.shiftright("_hash", 33) + (1 << 30)) * F.col("_in.own"), 31).cast("int")
    place = F.col("_in.at") + F.when(F.col("_in.first") == F.col("_key"), part).otherwise(F.col("_in.own"))
    keyed = keyed.withColumn("_step", coarse).join(fine, "_step").withColumn("_in", held).withColumn("_bucket", place).select("doc_id", "text", "_key", "_hash", "_bucket")
    in_order = Window.orderBy("_bucket")
    firsts = keyed.groupBy("_bucket").agg(F.min(F.struct("_key", "_hash")).alias("_first"))
    firsts = firsts.select("_first.*", F.coalesce(F.lag("_bucket").over(in_order), F.max("_bucket").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    firsts = materialize(firsts, "firsts")  # at most two rows for each of MOST_BUCKETS ranges
    guests = keyed.join(F.broadcast(firsts), ["_key", "_hash"]).select("doc_id", "text", "_key", "_hash", F.col("_to").alias("_bucket"), F.lit(1).alias("_guest"))
    everyone = keyed.withColumn("_guest", F.lit(0)).unionByName(guests).repartitionById(found[-1][1] + found[-1][2] + 1, "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_guest", "_key", "_hash", "text")
    following = everyone.withColumns(extra).withColumn("next", F.lead(F.struct("text", *extra)).over(order)).where("_guest = 0").select("doc_id", "text", *extra, "next")
    return following if copies is None else following.unionByName(copies.withColumns(extra).withColumn("next", F.struct("text", *extra)))


def compare_edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprint every document and its edited text, whose last half is the next document's beginning; see the columns of the result.

    ``docs`` has doc_id and text, other columns are ignored; a null text is an empty one, an empty table gives no rows. With one document alone, that is its own next one;
    see :func:`with_next` for null and repeated ids. ``n_chars`` counts code points (0 for null), the edited text is the first n_chars - floor(n_chars / 2) code points and then as many of the next document
    as were cut, or all it has. ``near_edited`` and ``near_next`` compare sets of chosen hashes (shared over all).
    """
    both = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), {"chosen": choices(F.col("text"), k, w)})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "chosen", F.col("next.chosen").alias("next_chosen"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)).alias("edited"))
    cut = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    both = both.withColumn("edited_chosen", edited_choices(F.col("chosen"), F.col("next_chosen"), F.col("edited"), cut, k, w))
    near = lambda other: let(hash_set(F.col("chosen")), lambda a: let(hash_set(F.col(other)), lambda b: likeness(a, b)))
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("chosen")).alias("fingerprint"), as_text(F.col("edited_chosen")).alias("edited_fingerprint"), near("edited_chosen").alias("near_edited"), near("next_chosen").alias("near_next"))
