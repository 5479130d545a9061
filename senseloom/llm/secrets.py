"""Secret scans with multipart credential linking.

Strong finds stand alone: assignments, access identifiers and long hex runs. Weak candidates (short or unusual identifiers, short
assigned values, unlabelled 40-character keys, endpoints) mean nothing by themselves. They are interval-joined with their complementary parts:
candidates whose spans lie in one scope (a paragraph), by default anywhere in it, else within ``reach`` characters of each other. A weak identifier is reported next to a
secret, a weak secret next to an identifier, an endpoint only where an identifier and a secret both are near. A span that overlaps a candidate is no complement of it.
"""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The whole scope.
REACH = sys.maxsize
_WEAK_ID = "AKIA|ASIA|AROA|AIDA|AGPA"

#: Base kinds in the order in which spans that start together are listed; the number is the group whose length counts and the least length.
BASE = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
#: Weak kinds: the part each of them would be.
WEAK = {
    "weak_id": ("id", re.compile(rf"(?<![A-Za-z0-9])(?:{_WEAK_ID})[A-Z0-9]{{8,124}}(?![A-Za-z0-9])")),
    "weak_key": ("secret", re.compile(r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")),
    "weak_assign": ("secret", re.compile(r"(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,11})(?![A-Za-z0-9+/_.=-])", re.I | re.A)),
    "endpoint": ("endpoint", re.compile(r"(?:https?|s3|ftp|postgres|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]+")),
}
PART = {"assign": "secret", "hex": "secret", "access": "id"}
NEEDS = {"id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
KINDS = [*BASE, *WEAK]
_PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n\s*")
_ASSIGN_HINT = re.compile("pass|secret|token|api_?key", re.I | re.A)

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Strong finds: of each kind's leftmost matches that do not overlap, those that are long enough."""
    found = []
    for k, (name, (pattern, group, least)) in enumerate(BASE.items()):
        if name == "assign" and not _ASSIGN_HINT.search(text):
            continue
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def _near(starts: list[int], ends: list[int], start: int, end: int, reach: int) -> bool:
    """Does one of the spans of a scope, given by its sorted starts and its sorted ends, stand within ``reach`` before or after [start, end)? One that overlaps it does not count."""
    after, before = bisect_left(starts, end), bisect_right(ends, start)
    return (after < len(starts) and starts[after] <= end + reach) or (before > 0 and ends[before - 1] >= start - reach)


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates whose complementary parts co-occur with them in a scope, by an interval join over sorted starts and ends. No part complements what it overlaps."""
    if not base and not ("://" in text or _ASSIGN_HINT.search(text) or re.search(_WEAK_ID, text)):
        return []  # no part that could stand next to another
    strong = {(k, s): e for s, k, e in base}
    weak: list[tuple[str, Span]] = []
    for name, (part, pattern) in WEAK.items():
        for m in pattern.finditer(text):
            span = (m.start(), KINDS.index(name), m.end())
            if not any(strong.get((k, span[0])) for k in range(len(BASE))):
                weak.append((part, span))
    if not weak:
        return []
    scopes = [m.end() for m in _PARAGRAPH.finditer(text)]
    parts: dict[tuple[int, str], list[Span]] = {}
    for part, span in [(PART[KINDS[s[1]]], s) for s in base] + weak:
        parts.setdefault((bisect_left(scopes, span[0] + 1), part), []).append(span)
    starts = {k: sorted(s for s, _, _ in x) for k, x in parts.items()}
    ends = {k: sorted(e for _, _, e in x) for k, x in parts.items()}
    kept = []
    for part, span in weak:
        scope = bisect_left(scopes, span[0] + 1)
        if all(_near(starts.get((scope, other), []), ends.get((scope, other), []), span[0], span[2], reach) for other in NEEDS[part]):
            kept.append(span)
    return sorted(kept)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Add the finds to every row: ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` and ``secrets``.

    ``spans`` lists all finds as kind:start:end (code points, end exclusive) by start, then kind, comma-joined; ``base_sha256`` is the SHA-256 of that list
    for the base kinds alone; ``secrets`` has the finds as structs with their text. Null and empty texts have none. Every row is
    scanned on its own, so repeated rows repeat their finds; columns of these names are replaced. All of a text is scanned; a
    text's finds are linked in time n log n. Neither shuffle nor state: a lost task is simply run again.
    """
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets"]
    kept = [c for c in docs.columns if c.lower() not in added]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, lists, finds = [], [], [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text) if text else []
                spans = sorted(base + linked_spans(text, base, reach)) if text else []
                counts.append([sum(k == i for _, k, _ in base) for i in range(3)])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(spans))
                finds.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for s, k, e in spans])
            n = np.array(counts, np.int64).reshape(-1, 3)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(n[:, i]) for i in range(3)), pa.array(digests), pa.array(lists, pa.string()), pa.array(finds, kind)], names=[*kept, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*kept).mapInArrow(find, f"{schema}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, secrets array<struct<kind:string,start:long,end:long,text:string>>")


def masked(text: str, spans: list[Span], mask: str) -> str:
    """Replace every find by ``mask``; finds that overlap are replaced as one."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, reach: int = REACH, mask: str = "[SECRET]") -> DataFrame:
    """Replace every find in ``text`` by ``mask`` and set ``n_chars`` anew where there is such a column; all rows stay, null texts too."""
    columns = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            new = []
            for text in texts:
                base = base_spans(text) if text else []
                spans = sorted(base + linked_spans(text, base, reach)) if text else []
                new.append(masked(text, spans, mask) if spans else text)
            arrays = [b.column(c) for c in columns]
            arrays[columns.index("text")] = pa.array(new, pa.string())
            if "n_chars" in columns:
                old = b.column("n_chars").to_pylist()
                arrays[columns.index("n_chars")] = pa.array([n if x == y else len(y) for n, x, y in zip(old, texts, new, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(clean, docs.schema)
