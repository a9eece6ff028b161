"""Observations of reads without gaps, all reads of a batch at once: the same rows as `walk.observations`, as arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_BASES = np.frombuffer(b"ACGT", np.uint8)
#: Place of a base in ACGT by its byte, 4 for all else.
_CODE = np.full(256, 4, np.int8)
_CODE[_BASES] = np.arange(4)
_LABELS = pa.array(["=" if a == b else f"{a}>{b}" for a in "ACGT" for b in "ACGT"])


def _joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes, the length of each and where it starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8), sizes, np.cumsum(sizes) - sizes


def observations(reads: dict[str, list], flank: tuple[int, int], m: int) -> dict[str, pa.Array | np.ndarray]:
    """Columns of the rows: `read` (the read's place), t, q, a window of 2m qualities, context, pos_start, pos_end, gc and op.

    reads: template, sequence, quality, clip_before, clip_after, masked, all of one length; sequences and templates are as long as
    each other. Qualities of clipped ends stand around the read's own.
    """
    left, right = flank
    templates = reads["template"]
    text, sizes, starts = _joined(templates)
    bases, _, _ = _joined(reads["sequence"])
    q, q_sizes, q_starts = _joined([a + b + c for a, b, c in zip(reads["clip_before"], reads["quality"], reads["clip_after"])])
    padded, _, p_starts = _joined(["." * left + t + "." * right for t in templates])
    read = np.repeat(np.arange(len(templates)), sizes)
    t = np.arange(len(text)) - starts[read]
    a, b = _CODE[text], _CODE[bases]
    kept = (a < 4) & (b < 4)
    for k, masked in enumerate(reads["masked"]):
        for site in masked or ():
            if 0 <= site < sizes[k]:
                kept[starts[k] + site] = False
    gc = np.zeros(len(templates), np.int64)
    np.add.at(gc, read, np.isin(text, _BASES[1:3]))
    read, t, label = read[kept], t[kept], (a * 4 + b)[kept]
    at = np.fromiter(map(len, reads["clip_before"]), np.int64, len(templates))[read] + t
    size, first = q_sizes[read], q_starts[read]
    near = []
    for k in range(1, m + 1):
        for o in (-k, k):
            there = (at + o >= 0) & (at + o < size)
            near.append(pa.array(q[first + np.where(there, at + o, 0)].astype(np.int32) - 33, mask=~there))
    windows = padded[(p_starts[read] + t)[:, None] + np.arange(left + right + 1)]
    return {
        "read": read, "t": pa.array(t.astype(np.int32)), "q": pa.array(q[first + at].astype(np.int32) - 33), "near": near,
        "context": pa.array(np.ascontiguousarray(windows).view(f"S{left + right + 1}").ravel().astype(str)),
        "pos_start": pa.array((at + 1).astype(np.int32)), "pos_end": pa.array((size - at).astype(np.int32)),
        "gc": pa.array((10 * np.minimum(9, 10 * gc // np.maximum(1, sizes)))[read].astype(np.int32)),
        "op": pa.DictionaryArray.from_arrays(pa.array(label.astype(np.int32)), _LABELS).cast(pa.string()),
    }
