"""Quality rules as a short-circuit cascade.

Every rule looks at a whole text and rejects it or not. On a sample each rule's cost (CPU seconds a document) and rejected share are estimated; the rules
then run in the order of rejection per cost, and a document leaves at the first rule that rejects it. A document is kept if no rule rejects it, so the verdict does
not hang on the order or on the clock; only the work does.

The counts come from the text's bytes: splitting at ASCII white space and ``bytes.translate`` need no character loop.
"""

from __future__ import annotations

import re
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from senseloom.llm.common import slices

#: Documents of the sample on which costs and selectivities are estimated, and the longest text in it.
SAMPLE = 2_000
SAMPLE_CHARS = 20_000
SEED = 13
WINDOW = 5

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalpha())
_ALL = bytes(range(256))
#: Case of words: A and a stand for capitals and small letters of ASCII, the rest of a word goes.
_CASE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 else b for b in range(256))
_CAPITALS = re.compile(rb"(?<![Aa])A{2,}(?![Aa])")


def without(*kept: bytes) -> bytes:
    return bytes(b for b in _ALL if not any(b in k for k in kept))


def repeated_words(ids: np.ndarray, kinds: int, width: int = WINDOW) -> int:
    """How many places lie in a window of ``width`` ids that occurs at least twice. ``ids`` are numbers under ``kinds``; windows are compared exactly."""
    if len(ids) <= width:
        return 0
    n = len(ids) - width + 1
    key, most = ids[:n], kinds
    for i in range(1, width):
        if most * kinds >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            most = int(key.max()) + 1
        key, most = key * kinds + ids[i : i + n], most * kinds
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(key, np.unique(twice)))
    edge = np.bincount(starts, minlength=len(ids) + 1) - np.bincount(starts + width, minlength=len(ids) + 1)
    return int((np.cumsum(edge) > 0).sum())


class Text:
    """A text's counts, each one computed when it is first asked for."""

    def __init__(self, raw: bytes, n_chars: int):
        self.raw, self.n_chars = raw, n_chars

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return self.n_chars - sum(map(self.raw.count, (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def repeated_share(self) -> float:
        """Bytes in lines equal to an earlier one, of the bytes in all lines with a word."""
        whole = sum(map(len, self.lines))
        return (whole - sum(map(len, set(self.lines)))) / whole if whole else 0.0

    @cached_property
    def n_repeat_words(self) -> int:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        return repeated_words(np.fromiter(map(numbers.__getitem__, self.words), np.int64, self.n_words), len(numbers))

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the one before."""
        return sum(map(eq, self.words, self.words[1:]))

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter of ASCII or anything beyond ASCII."""
        return len(self.raw.translate(None, without(_LETTERS, _SPACE)).split())

    @cached_property
    def n_capitals(self) -> int:
        """Words with two or more of A-Z and none of a-z."""
        return len(_CAPITALS.findall(self.raw.translate(_CASE, without(bytes(range(65, 91)), bytes(range(97, 123)), _SPACE))))

    @cached_property
    def n_open_lines(self) -> int:
        """Lines with a word that end in dots of an ellipsis."""
        return sum(x.rstrip(_SPACE).endswith((b"...", "…".encode())) for x in self.lines)

    @cached_property
    def n_bullets(self) -> int:
        """Lines with a word that start as an item of a list."""
        return sum(x.lstrip(_SPACE).startswith((b"- ", b"* ", "• ".encode())) for x in self.lines)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


BASE = (Rule("few_words", lambda t: t.n_words < 10), Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words))
#: Thresholds follow the published rules for web text: mean length of words, symbols, repeated lines and words, letters, capitals, ellipses, bullets.
RULES = (
    *BASE,
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 12 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: t.repeated_share > 0.3),
    Rule("stutters", lambda t: 10 * t.n_stutters > 2 * t.n_words),
    Rule("letters", lambda t: 2 * t.n_lettered < t.n_words),
    Rule("capitals", lambda t: 10 * t.n_capitals > 3 * t.n_words),
    Rule("open_lines", lambda t: 10 * t.n_open_lines > 3 * len(t.lines)),
    Rule("bullets", lambda t: 10 * t.n_bullets > 9 * len(t.lines)),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[Text]:
    texts = batch.column(column)
    for raw, n in zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist(), strict=True):
        yield Text(raw or b"", n or 0)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, max_chars: int = SAMPLE_CHARS, seed: int = SEED) -> list[dict]:
    """Cost and selectivity of each rule on about ``sample`` documents: name, seconds and rejected share of a document, and the rank by rejection per second.

    Documents are drawn by a seeded hash of id and text's length, those of more than ``max_chars`` characters left out; each rule is timed on its own, on a text of which nothing is
    known yet. The tasks return one row per rule. On an empty sample all rules cost and reject nothing and stay in the given order.
    """
    share = F.lit(min(1.0, sample / max(1, docs.count())))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.length("text")), F.lit(1 << 30)) < share * F.lit(float(1 << 30))
    texts = docs.where(drawn & (F.coalesce(F.length("text"), F.lit(0)) <= max_chars)).select("text")

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for b in batches:
            for t in texts_of(b):
                n += 1
                for i, rule in enumerate(rules):
                    fresh, began = Text(t.raw, t.n_chars), time.thread_time()
                    rejected[i] += rule.rejects(fresh)
                    seconds[i] += time.thread_time() - began
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(seconds), pa.array(rejected), pa.array(np.full(len(rules), n))], names=["name", "seconds", "rejected", "n"])

    sums = texts.mapInArrow(trial, "name string, seconds double, rejected long, n long").groupBy("name").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n"))
    held = {x["name"]: x for x in sums.collect()}  # one row per rule
    rows = [{"name": r.name, "seconds": held[r.name]["s"] / held[r.name]["n"] if r.name in held else 0.0, "rejected": held[r.name]["r"] / held[r.name]["n"] if r.name in held else 0.0} for r in rules]
    order = sorted(range(len(rows)), key=lambda i: (-rows[i]["rejected"] / max(rows[i]["seconds"], 1e-9), rows[i]["seconds"], i))
    return [x | {"rank": order.index(i)} for i, x in enumerate(rows)]


def ordered(rules: tuple[Rule, ...], estimates: list[dict]) -> tuple[Rule, ...]:
    rank = {x["name"]: x["rank"] for x in estimates}
    return tuple(sorted(rules, key=lambda r: rank[r.name]))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = ()) -> DataFrame:
    """Add ``kept`` and ``rejected_by`` (the first rule in the given order that rejects the text, null if kept) to every row, and the counts in ``measures``.

    Null and empty texts have no words. Rows are judged one by one: repeated rows get the same verdict, an empty table gives an empty one; columns of the added
    names are replaced, in any case. Whole texts are judged, however long, in slices of bounded size. No shuffle and no state: a lost task is run again.
    """
    added = (*measures, "kept", "rejected_by")
    columns = [c for c in docs.columns if c.lower() not in added]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                counts, reasons = [], []
                for t in texts_of(b):
                    reasons.append(next((r.name for r in rules if r.rejects(t)), None))
                    counts.append([getattr(t, m) for m in measures])
                n = np.array(counts, np.int64).reshape(len(counts), len(measures))
                arrays = [*(b.column(c) for c in columns), *(pa.array(n[:, i]) for i in range(len(measures))), pa.array([r is None for r in reasons], pa.bool_()), pa.array(reasons, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *added])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns), *(f"{m} long" for m in measures), "kept boolean, rejected_by string"])
    return docs.select(*(F.col(f"`{c.replace('`', '``')}`") for c in columns)).mapInArrow(judge, schema)


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Estimate, order and apply the rules, with all base counts and ``base_failed`` (rejected by one of the two base rules)."""
    judged = cascade(docs, ordered(rules, estimate(docs, rules)), MEASURES)
    return judged.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


SCORE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
five AS (SELECT *, lead(w, 4) OVER o IS NOT NULL AS whole, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS win, w = lag(w) OVER o AS stutter FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT *, whole AND count(*) OVER (PARTITION BY doc_id, whole, win) > 1 AS again FROM five),
covered AS (SELECT doc_id, w, stutter, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rep FROM twice),
per_word AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count_if(rep)::BIGINT AS n_repeat_words, count_if(stutter) AS stutters,
    count_if(regexp_matches(w, '[A-Za-z\x{80}-\x{10FFFF}]')) AS lettered, count_if(regexp_matches(w, '[A-Z].*[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS capitals FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
alike AS (SELECT doc_id, line, count(*) AS c FROM lines GROUP BY ALL),
per_line AS (SELECT doc_id, sum(c) AS n_lines, (sum(c) - count(*))::BIGINT AS n_dup_lines, sum((c - 1) * strlen(line)) / sum(c * strlen(line)) AS repeated, coalesce(sum(c) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')), 0) AS open,
    coalesce(sum(c) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]\x20')), 0) AS bullets FROM alike GROUP BY doc_id),
j AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lettered, stutters, capitals, n_lines, repeated, open, bullets FROM docs d LEFT JOIN per_word USING (doc_id) LEFT JOIN per_line USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND 10 * n_symbols <= n_words AND repeated <= 0.3 AND 10 * stutters <= 2 * n_words AND 2 * lettered >= n_words
    AND 10 * capitals <= 3 * n_words AND 10 * open <= 3 * n_lines AND 10 * bullets <= 9 * n_lines AS kept FROM b
"""
