"""Arrow batches of a sorted partition, as tables that hold all rows of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 10_000


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, the last one aside, none of which shares a value of ``key`` with another; batches are sorted by it."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= rows and (cut := pc.index(b.column(key), b.column(key)[-1]).as_py() or 0) + n and b.column(key)[-1] != held[-1].column(key)[-1]:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, n = [], 0
            b = b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def coded(strings: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of strings in the order of their code points, from 0 without gaps, and the strings of the numbers."""
    held = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
    encoded = pc.dictionary_encode(held)
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[encoded.indices.to_numpy()], encoded.dictionary.take(pa.array(order))
