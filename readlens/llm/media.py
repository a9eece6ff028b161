"""Bytes as PNG images in binary columns: written and read chunk by chunk, with a low-frequency cosine hash of the picture.

Images are 8-bit grey and as wide as `width`; row r of the picture is bytes r*width to (r+1)*width of the payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages
from .rows import added, typed

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
IDAT_BYTES = 1 << 20
#: Rows filtered at a time, so that a tall picture needs no more memory than a band.
BAND = 4096
SIDE, LOW = 32, 8


class MediaError(ValueError):
    """A stored image that can't be read whole."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Each row behind its filter's number; of None, Sub and Up the one with the least sum of signed magnitudes."""
    height, width = rows.shape
    out = np.empty((height, width + 1), np.uint8)
    for top in range(0, height, BAND):
        band = rows[top : top + BAND]
        above = np.zeros_like(band)
        above[1:] = band[:-1]
        if top:
            above[0] = rows[top - 1]
        left = np.zeros_like(band)
        left[:, 1:] = band[:, :-1]
        kinds = (band, band - left, band - above)
        cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in kinds])
        best = cost.argmin(axis=0)
        out[top : top + BAND, 0] = best
        for kind, x in enumerate(kinds):
            chosen = np.flatnonzero(best == kind)
            out[top + chosen, 1:] = x[chosen]
    return out


def write_png(payload: bytes, width: int, level: int = 1) -> bytes:
    """The payload as a grey image; its length must be a positive multiple of width."""
    if not payload or len(payload) % width:
        raise MediaError(f"{len(payload)} bytes don't fill rows of {width}")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body = zlib.compress(_filtered(rows).tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(SIGNATURE):
        raise MediaError("no PNG signature")
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            break
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"wrong checksum in {kind!r} at {at}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise MediaError("the image ends within a chunk")


def _sequential(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Average and Paeth need each sample's left neighbour."""
    out, up = row.tolist(), above.tolist()
    left = corner = 0
    for i, b in enumerate(up):
        if kind == AVERAGE:
            guess = (left + b) >> 1
        else:
            p = left + b - corner
            pa_, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
            guess = left if pa_ <= pb and pa_ <= pc else b if pb <= pc else corner
        out[i] = left = (out[i] + guess) & 255
        corner = b
    return np.array(out, np.uint8)


def _unfiltered(raw: np.ndarray) -> np.ndarray:
    """Undo the row filters. Runs of rows of one kind are undone together: Sub by sums along rows, Up by sums down columns."""
    kinds, rows = raw[:, 0], np.array(raw[:, 1:])
    if kinds.size and kinds.max() > PAETH:
        raise MediaError("unknown filter")
    flat = np.flatnonzero(kinds == SUB)
    for top in range(0, len(flat), BAND):
        at = flat[top : top + BAND]
        rows[at] = np.cumsum(rows[at], axis=1, dtype=np.uint8)
    bounds = np.flatnonzero(np.diff(kinds, prepend=255, append=255))
    for start, stop in zip(bounds, bounds[1:]):
        kind = kinds[start]
        above = rows[start - 1] if start else np.zeros(rows.shape[1], np.uint8)
        if kind == UP:
            rows[start] += above
            rows[start:stop] = np.cumsum(rows[start:stop], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for r in range(start, stop):
                rows[r] = above = _sequential(int(kind), rows[r], above)
    return rows


def read_png(data: bytes) -> np.ndarray:
    """Rows of an 8-bit grey image; every chunk's checksum is tested, as is zlib's over all rows."""
    head, body = b"", []
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            head = part
        elif kind == b"IDAT":
            body.append(part)
    if len(head) != 13:
        raise MediaError("no header")
    width, height, *rest = struct.unpack(">IIBBBBB", head)
    if rest != [8, 0, 0, 0, 0]:
        raise MediaError("only 8-bit grey images without interlacing are read")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as error:
        raise MediaError(str(error)) from error
    if len(raw) != height * (width + 1):
        raise MediaError("the rows don't fill the image")
    return _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@cache
def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


@cache
def _areas(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First sample of each of SIDE cells over n samples, and the cells' sizes; cells share samples where n is under SIDE."""
    first = np.arange(SIDE) * n // SIDE
    last = np.maximum(np.arange(1, SIDE + 1) * n // SIDE, first + 1)
    return first, last


def cosine_hash(rows: np.ndarray) -> bytes:
    """64 bits: which of the 8 by 8 lowest cosine terms of the picture, shrunk to 32 by 32 cells, exceed their median.

    Cells' sums are whole numbers; of a tall picture no more is held than the sums of its columns in each cell.
    """
    a, b = _areas(rows.shape[1])
    top, bottom = _areas(rows.shape[0])
    if rows.shape[0] > BAND:
        down = np.stack([rows[x:y].sum(axis=0, dtype=np.int64) for x, y in zip(top, bottom)])
    else:
        sums = np.concatenate((np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows, axis=0, dtype=np.int64)))
        down = sums[bottom] - sums[top]
    across = np.concatenate((np.zeros((SIDE, 1), np.int64), np.cumsum(down, axis=1)), axis=1)
    cells = (across[:, b] - across[:, a]) / ((bottom - top)[:, None] * (b - a))
    terms = np.round(_cosines() @ cells @ _cosines().T, 6)
    return np.packbits(terms > np.median(terms)).tobytes()


def payload_of(text: str | None, width: int) -> tuple[int, bytes]:
    """A text's UTF-8 length, and its bytes with blanks up to the next positive multiple of width."""
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % width if data else width)


def store(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, png) of every row: its text as a stored image. A null text is empty and gives one row of blanks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(n, write_png(payload, width)) for n, payload in (payload_of(t.as_py(), width) for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in made], pa.int64()), pa.array([p for _, p in made], pa.binary())], names=["id", "n_bytes", "png"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, typed(rows, ["id"], "n_bytes long, png binary"))


def features(df: DataFrame, png_col: str = "png") -> DataFrame:
    """df with `payload` (binary, read back from the image) and `feature` (binary, its cosine hash), in place of columns of
    these names. A null image has neither; a broken one raises."""
    kept, schema = added(df, png_col, "payload binary, feature binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, hashes = [], []
            for data in batch.column(png_col):
                rows = read_png(data.as_py()) if data.is_valid else None
                payloads.append(None if rows is None else rows.tobytes())
                hashes.append(None if rows is None else cosine_hash(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(payloads, pa.binary()), pa.array(hashes, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df, of the image that `store` makes, of the bytes read back from it and of their feature (hex).

    The images are written as a table, and what `features` reads is that table. Equal texts give equal values.
    """
    stored = Stages(df.sparkSession, "media").write(store(df, width, id_col, text_col), "stored")
    tail = F.expr("substring(payload, -16, 16)")
    return features(stored).select(
        F.col("id").alias("doc_id"), "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("png").cast("long").alias("media_bytes"), F.sha2("png", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature"),
    )
