"""Texts as codepoint arrays: words, word hashes and shingles of many texts in a few numpy passes.

A word is a maximal run of letters, marks and digits, lower-cased; all else separates words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Ends each text in a joined array; no text from Arrow can hold a surrogate.
END = 0xD800
_ALL = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def categories() -> np.ndarray:
    """For each codepoint the first letter of its general category, as a byte."""
    return np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(_ALL)).encode(), np.uint8)


@cache
def word_values() -> np.ndarray:
    """0 for codepoints that separate words, else a random value of the lower-cased codepoint."""
    inside = np.isin(categories(), np.frombuffer(b"LMN", np.uint8))
    lower = np.arange(_ALL, dtype=np.uint64)
    for c in np.flatnonzero(np.isin(categories(), np.frombuffer(b"L", np.uint8))[:0x20000]):
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    return np.where(inside, mix(lower + np.uint64(1)) | np.uint64(1), np.uint64(0))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.full(n, _BASE)
    inverse = np.full(n, _BASE_INVERSE)
    ones[0] = inverse[0] = 1
    return np.multiply.accumulate(ones), np.multiply.accumulate(inverse)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(18, int(n).bit_length()))
    return up[:n], down[:n]


def chunks(texts: Iterable[str | None], chars: int = 250_000) -> Iterator[list[str]]:
    """Runs of whole texts of about so many characters; a longer text stands alone. Null counts as empty."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts joined, each followed by END; and the places of those ENDs."""
    joined = "\ud800".join(texts) + "\ud800"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return cp, np.flatnonzero(cp == END)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, offsets of each text's words, the character values, and the texts' ENDs.

    Starts and ends index the joined codepoints of `codepoints`.
    """
    cp, ends = codepoints(texts)
    values = word_values()[cp]
    inside = np.zeros(len(cp) + 1, np.int8)
    inside[1:] = values != 0
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    stops = np.flatnonzero(step == -1)  # every word ends before the END of its text
    up, down = powers(len(cp) + 1)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    hashes = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    offsets = np.concatenate(([0], np.searchsorted(starts, ends)))
    return hashes, starts, stops, offsets, values, ends


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, in text order, and the offsets of each text's.

    A text of one to k-1 words has one shingle, of all its words; one without words has none.
    """
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(n)), counts)
    first = offsets[:-1][text] + np.arange(out_offsets[-1]) - out_offsets[:-1][text]
    width = np.minimum(n, k)[text]
    total = np.zeros(len(first), np.uint64)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    for i in range(k):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += np.where(i < width, padded[first + i], np.uint64(0)) if len(first) and width.min() < k else padded[first + i]
    return mix(total), out_offsets
