"""Byte-level BPE encoding and decoding: slices from `pretokens`, cached pair merging, offsets kept for decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens, textvec
from .rows import added, typed

#: Slices whose ids a task remembers as recent ones, and as many as older ones; longer slices aren't remembered. A worker
#: remembers the KEPT first met ones between tasks.
CACHE, CACHED_SIGNS, KEPT = 250_000, 64, 40_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: of all adjacent pairs the one of lowest rank, leftmost first, is joined until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    ends = list(range(1, n + 1))  # 0: joined to the part before it
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, width = heappop(heap)
        j = after[i]
        if not ends[i] or j >= n or ends[j] - i != width:  # one of the two parts has changed since
            continue
        ends[i], ends[j] = ends[j], 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : ends[k]])) is not None:
                heappush(heap, (r, i, ends[k] - i))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h : ends[i]])) is not None:
            heappush(heap, (r, h, ends[i] - h))
    out = []
    i = 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class _Cache(dict):
    """What is made of a slice, for as many recent slices as CACHE and as many older ones."""

    def __init__(self, make: Callable[[str | bytes], bytes], longest: int) -> None:
        super().__init__()
        self.make, self.longest = make, longest
        self.older: dict[str | bytes, bytes] = {}

    def __missing__(self, key: str | bytes) -> bytes:
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


    def rest(self) -> None:
        """Let go of all but the slices that were met first, among which are the frequent ones."""
        kept = dict(islice(self.items(), KEPT))
        self.clear()
        self.older = {}
        self.update(kept)


class Codec:
    """Encodes and decodes texts by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.known = _Cache(lambda text: np.array(merge(text.encode(), ranks), "<u4").tobytes(), CACHED_SIGNS)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text its ids, and the place of the first id of each slice with one past the last at the end."""
        found, offsets = pretokens.slices(texts)
        parts = list(map(self.known.__getitem__, found))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        places = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.frombuffer(b"".join(parts), "<u4")
        cuts = places[offsets].tolist()
        bounds = offsets.tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])], [places[a : b + 1] - places[a] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: np.ndarray, places: np.ndarray | None = None) -> bytes:
        """The bytes of ids; where the places of the slices are known, slice by slice."""
        if places is None:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        own, at = ids.tolist(), places.tolist()
        tokens = self.tokens.__getitem__
        return b"".join([tokens(own[a]) if b == a + 1 else b"".join(map(tokens, own[a:b])) for a, b in zip(at, at[1:])])


_codecs: dict[str, Codec] = {}


def codec(path: str, ranks: Callable[[], dict[bytes, int]]) -> Codec:
    """This process's codec for a rank file, kept between batches and tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(ranks())
    return _codecs[path]


def _encoder(path: str, shared, row: Callable[[Codec, str, np.ndarray, np.ndarray], dict], schema: pa.Schema, text_col: str, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, lambda: shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            columns: dict[str, list] = {f.name: [] for f in schema}
            for chunk in textvec.chunks(texts):
                for text, ids, places in zip(chunk, *own.encode(chunk)):
                    for name, value in row(own, text, ids, places).items():
                        columns[name].append(value)
            made = [*(batch.column(n) for n in keep), *(pa.array(columns[f.name], f.type) for f in schema)]
            yield pa.RecordBatch.from_arrays(made, names=[*keep, *schema.names])
        own.known.rest()

    return run


def encode(df: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, slice_offsets) of every row of df; a null or empty text has no ids.

    ids are the tokens' ranks; slice_offsets has the place of each slice's first id and then their number. Rows keep
    their number, repeated and null ids included; all other columns of df are left out.
    """
    spark = df.sparkSession
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("slice_offsets", pa.list_(pa.int32()))])
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))
    run = _encoder(rank_path, shared, lambda own, text, ids, places: {"ids": ids.astype(np.int32), "slice_offsets": places.astype(np.int32)}, schema, "text", ["id"])
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, typed(rows, ["id"], "ids array<int>, slice_offsets array<int>"))


def decode(df: DataFrame, rank_path: str, ids_col: str = "ids", offsets_col: str | None = None) -> DataFrame:
    """df with a column `decoded` (binary), in place of one of that name: the bytes of its ids, slice by slice if offsets_col
    is given. Null ids decode to no bytes; an id without a token raises."""
    kept, schema = added(df, ids_col, "decoded binary")
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, lambda: shared.value)
        for batch in batches:
            places = batch.column(offsets_col).to_pylist() if offsets_col else [None] * batch.num_rows
            made = [own.decode(np.array(ids or [], np.int64), None if at is None else np.array(at, np.int64)) for ids, at in zip(batch.column(ids_col).to_pylist(), places)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(made, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_slices, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    schema = pa.schema([("n_tokens", pa.int64()), ("n_slices", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(own: Codec, text: str, ids: np.ndarray, places: np.ndarray) -> dict:
        return {
            "n_tokens": len(ids),
            "n_slices": len(places) - 1,
            "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(),
            "decoded_sha256": hashlib.sha256(own.decode(ids, places)).hexdigest(),
        }

    run = _encoder(rank_path, shared, row, schema, "text", ["doc_id"])
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, typed(rows, ["doc_id"], "n_tokens long, n_slices long, ids_sha256 string, decoded_sha256 string"))
