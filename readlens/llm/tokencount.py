"""Token counts of a text by a byte-level BPE tokenizer file: a heap of ranked pairs over a linked list of symbols.

The count of a slice is its initial symbols less its merges; no token ids are made.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens, textvec
from .rows import typed

#: Slices whose count a task remembers as recent ones, and as many as older ones; longer slices aren't remembered. A worker
#: remembers the KEPT first met ones between tasks.
CACHE, CACHED_SIGNS, KEPT = 250_000, 64, 40_000
#: A symbol's number needs so many bits in a pair's key.
_BITS = 20


@dataclass
class Merges:
    """symbols: the first symbol of each byte; pairs: key of a pair to (rank, joined symbol); special: whole strings that are one token."""

    symbols: list[int]
    pairs: dict[int, tuple[int, int]]
    special: list[str]


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte in such files: itself if visible in Latin-1, else the next one past 255."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def read_merges(path: str) -> Merges:
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    vocab = data["model"]["vocab"]
    pairs = {}
    for rank, (a, b) in enumerate(data["model"]["merges"]):
        pairs.setdefault(vocab[a] << _BITS | vocab[b], (rank, vocab[a + b]))
    return Merges([vocab[s] for s in _byte_signs()], pairs, [t["content"] for t in data["added_tokens"]])


def count(piece: bytes, merges: Merges) -> int:
    """Tokens of one slice."""
    pairs = merges.pairs
    symbol = [merges.symbols[b] for b in piece]
    n = left = len(symbol)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(*found, i, symbol[i] << _BITS | symbol[i + 1]) for i in range(n - 1) if (found := pairs.get(symbol[i] << _BITS | symbol[i + 1]))]
    heapify(heap)
    while heap:
        _, joined, i, key = heappop(heap)
        j = after[i]
        if symbol[i] < 0 or j >= n or symbol[i] << _BITS | symbol[j] != key:  # the pair is no longer there
            continue
        symbol[i], symbol[j] = joined, -1
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            key = joined << _BITS | symbol[k]
            if found := pairs.get(key):
                heappush(heap, (*found, i, key))
        h = before[i]
        if h >= 0:
            key = symbol[h] << _BITS | joined
            if found := pairs.get(key):
                heappush(heap, (*found, h, key))
    return left


class Counter(dict):
    """Slice to its number of tokens."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges
        self.older: dict[str, int] = {}

    def __missing__(self, text: str) -> int:
        if len(text) > CACHED_SIGNS:
            return count(text.encode(), self.merges)
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        if (known := self.older.get(text)) is not None:
            self[text] = known
            return known
        out = self[text] = count(text.encode(), self.merges)
        return out

    def rest(self) -> None:
        """Let go of all but the slices that were met first, among which are the frequent ones."""
        kept = dict(islice(self.items(), KEPT))
        self.clear()
        self.older = {}
        self.update(kept)

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. A special string within a text is one token and cuts the text, as the library has it by default."""
        extra = [0] * len(texts)
        parts, owner = texts, None
        if any(s in t for s in self.merges.special for t in texts):
            parts, owner = [], []
            for k, text in enumerate(texts):
                cut = [text]
                for special in self.merges.special:
                    cut = [y for x in cut for y in x.split(special)]
                extra[k] = len(cut) - 1
                parts += cut
                owner += [k] * len(cut)
        out = [0] * len(texts)
        done = 0
        for chunk in textvec.chunks(parts):
            found, offsets = pretokens.slices(chunk)
            total = np.concatenate(([0], np.cumsum(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))))
            for k, n in enumerate(np.diff(total[offsets]).tolist(), done):
                out[owner[k] if owner else k] += n
            done += len(chunk)
        return [a + b for a, b in zip(out, extra)]


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row. A null text is empty: no bytes, no tokens, not over.

    Rows keep their number, repeated and null ids included; other columns of df are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_merges(tokenizer_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = Counter(shared.value)
        own = _counters[tokenizer_path]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = np.array(own.texts(texts), np.int64)
            sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            made = [batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        own.rest()

    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, typed(rows, ["doc_id"], "n_bytes long, n_tokens long, over_limit boolean"))
