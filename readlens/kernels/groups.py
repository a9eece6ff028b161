"""Rows of whole numbers added up as arrays: what a task counts before Spark adds up what its tasks found."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Signs of text that are worked on at once, about.
CHUNK = 1 << 20
_LARGEST = 1 << 62
_DENSE = 1 << 22


def grouped(columns: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of columns of whole numbers from 0 on, in order, and how often each occurs."""
    if not len(columns[0]):
        return [c[:0] for c in columns], np.zeros(0, np.int64)
    key, span, steps = np.zeros(len(columns[0]), np.int64), 1, []
    for c in columns:
        size = int(c.max()) + 1
        if span * size >= _LARGEST:  # numbers of the rows so far take their place
            known, key = np.unique(key, return_inverse=True)
            span = len(known)
            steps.append(known)
        key = key * size + c
        span *= size
        steps.append(size)
    if span <= min(_DENSE, 16 * len(key)):
        n = np.bincount(key)
        keys = np.flatnonzero(n)
        n = n[keys]
    else:
        keys, n = np.unique(key, return_counts=True)
    out = []
    for step in reversed(steps):
        if isinstance(step, np.ndarray):
            keys = step[keys]
        else:
            out.append(keys % step)
            keys = keys // step
    return out[::-1], n


def chunks(batches: Iterable[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches put together until a column of text has so many bytes, or one of arrays so many entries; none without rows."""
    held: list[pa.RecordBatch] = []
    bytes_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        own = batch[text]
        bytes_held += len(own.flatten()) if pa.types.is_list(own.type) else pc.sum(pc.binary_length(own)).as_py() or 0
        if bytes_held >= size:
            yield pa.concat_batches(held)
            held, bytes_held = [], 0
    if held:
        yield pa.concat_batches(held)


def codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, null being one, and the value of each number."""
    found = column.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, none of them null, and the length of each text."""
    whole = "".join(texts.to_pylist())
    found = np.frombuffer(whole.encode("ascii"), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    return found, pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def values_at(lists: pa.ListArray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, int]:
    """What rows of a column of whole numbers' arrays have at 0-based places: numbers from 1 on, 0 for nothing; and what to add to them."""
    values = lists.flatten()
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    low = pc.min(values).as_py() or 0
    shifted = np.append(pc.subtract(values, low).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) + 1, 0)
    there = (place >= 0) & (place < length[row])
    return shifted[np.where(there, (np.cumsum(length) - length)[row] + place, len(values))], low - 1
