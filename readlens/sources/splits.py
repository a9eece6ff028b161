"""Parts of FASTQ, SAM and BAM files that can be read apart: byte ranges of plain files, ranges of blocks of block-gzipped ones.

A part of lines owns the records whose first line starts within it or right at its end, and reads on until the last of them is whole;
it begins behind the first line end, at the first place where four lines make a record.
"""

from __future__ import annotations

import io
import itertools
import os
import struct
import zlib
from collections.abc import Iterator

CHUNK = 1 << 20
#: Start of a block: a gzip member with one extra field, BC, that has the block's size.
_MAGIC = b"\x1f\x8b\x08\x04"
_HEADER = 18


def block_size(head: bytes) -> int | None:
    """The whole size of the block that begins so, or None if none does."""
    if len(head) < _HEADER or head[:4] != _MAGIC or head[10:16] != b"\x06\0BC\2\0":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def kind(path: str) -> str:
    """plain, blocks (gzip whose members are blocks of known size) or gzip."""
    with open(path, "rb") as file:
        head = file.read(_HEADER)
    return "plain" if head[:2] != b"\x1f\x8b" else "blocks" if block_size(head) else "gzip"


def ranges(path: str, size: int) -> list[tuple[int, int]]:
    """Byte ranges of about so many bytes; of a file that can't be split, one."""
    whole = os.path.getsize(path)
    if size < 1:
        raise ValueError("a part has one byte at least")
    if kind(path) == "gzip" or whole <= size:
        return [(0, whole)]
    return [(a, min(a + size, whole)) for a in range(0, whole, size)]


def _plain(file: io.BufferedReader, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    file.seek(start)
    at = start
    while data := file.read(min(CHUNK, end - at) if at < end else CHUNK):
        yield data, at < end
        at += len(data)


def _blocks(file: io.BufferedReader, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """Unzipped blocks from the first that begins in the range on. A block's start is told from chance by the blocks that follow it."""

    def size_at(place: int) -> int | None:
        file.seek(place)
        return block_size(file.read(_HEADER))

    file.seek(0, io.SEEK_END)
    whole, at = file.tell(), start
    while at < min(end, whole):
        file.seek(at)
        data = file.read(CHUNK + _HEADER)
        found = data.find(_MAGIC)
        if found < 0:
            at += max(1, len(data) - len(_MAGIC) + 1)
            continue
        at += found
        size = size_at(at)
        if at < end and size and (at + size == whole or size_at(at + size)):
            break
        at += 1
    else:
        return
    while at < whole:
        size = size_at(at)
        if not size:
            raise ValueError(f"no block at byte {at}")
        file.seek(at)
        yield zlib.decompress(file.read(size), 31), at < end
        at += size


def _lines(chunks: Iterator[tuple[bytes, bool]]) -> Iterator[tuple[bytes, bool]]:
    """(line, whether it starts within the part or right at its end)."""
    held, start, read = b"", 0, 0
    end: int | None = None
    for data, inside in chunks:
        if not inside and end is None:
            end = read
        *whole, held = (held + data).split(b"\n")
        for line in whole:
            yield line + b"\n", end is None or start <= end
            start += len(line) + 1
        read += len(data)
    if held:
        yield held, end is None or start <= end


def _rest_of_one(text: list[bytes]) -> bool:
    """Whether a file's last lines can be what is left of a record."""
    text = [x for x in text if x]
    return len(text) < 2 or len(text) == 2 and text[0].startswith(b"+") or len(text) == 3 and text[1].startswith(b"+")


def _found(lines: Iterator[tuple[bytes, bool]], name: str) -> list[tuple[bytes, bool]]:
    """The four lines of the first whole record; none if the part has no more. At most three lines are left of the one before."""
    from .fastq import FastqFormatError

    ahead: list[tuple[bytes, bool]] = []
    skipped = 0
    while True:
        while len(ahead) < 4 and (line := next(lines, None)):
            ahead.append(line)
        if not ahead or not ahead[0][1]:
            return []
        text = [x.rstrip(b"\r\n") for x, _ in ahead]
        if len(ahead) == 4 and text[0].startswith(b"@") and text[2].startswith(b"+") and len(text[1]) == len(text[3]):
            return ahead
        if len(ahead) < 4 and not skipped and _rest_of_one(text):
            return []
        skipped += bool(text[0])
        if skipped > 3:
            raise FastqFormatError(f"{name}: no whole record starts here")
        ahead.pop(0)


def records(path: str, start: int, end: int) -> Iterator[tuple[str, str, str]]:
    """(name, bases, qualities) of the records that the part of a file owns. Broken ones raise, named by the part's first byte."""
    from . import fastq

    name = f"{path}@{start}"
    if kind(path) == "gzip":
        with fastq.opened(path) as file:
            yield from fastq.records(iter(file), path)
        return
    with open(path, "rb") as file:
        lines = _lines((_blocks if kind(path) == "blocks" else _plain)(file, start, end))
        ahead: list[tuple[bytes, bool]] = []
        if start:
            next(lines, None)
            if not (ahead := _found(lines, name)):
                return
        rest = itertools.chain(ahead, lines)
        for line, own in rest:
            if not line.strip():
                continue
            if not own:
                return
            yield from fastq.records(iter([line, *(x for x, _ in (next(rest, (b"", False)) for _ in range(3)) if x)]), name)


def lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """Lines that begin within a part of a file or right at its end, but for that which begins right at its start, unless it is the file's."""
    with open(path, "rb") as file:
        found = _lines((_blocks if kind(path) == "blocks" else _plain)(file, start, end))
        if start:
            next(found, None)
        for line, own in found:
            if not own:
                return
            yield line


class _Stream:
    """Unzipped bytes of a part by their place, and where what it owns ends, once that has been read."""

    def __init__(self, chunks: Iterator[tuple[bytes, bool]]) -> None:
        self.chunks, self.data, self.first, self.end, self.over = chunks, bytearray(), 0, None, False

    def has(self, place: int, n: int) -> bool:
        """Whether there are n bytes from a place on; reads until there are."""
        while not self.over and self.first + len(self.data) < place + n:
            chunk, inside = next(self.chunks, (None, False))
            if chunk is None:
                self.over = True
                break
            if not inside and self.end is None:
                self.end = self.first + len(self.data)
            self.data += chunk
        return self.first + len(self.data) >= place + n

    def get(self, place: int, n: int) -> bytes:
        return bytes(self.data[place - self.first : place - self.first + n])

    def forget(self, place: int) -> None:
        if place - self.first > 4 * CHUNK:
            del self.data[: place - self.first]
            self.first = place


#: Records in a row that have to be sound for a place to count as the start of one.
_SOUND = 4


def _sound(stream: _Stream, place: int, lengths: list[int]) -> int | None:
    """Where the record after one at this place would begin, or None if none can be here."""
    if not stream.has(place, 36):
        return None
    size, ref, pos, name, _, _, ops, _, bases, other, other_pos, _ = struct.unpack("<iiiBBHHHiiii", stream.get(place, 36))
    if not (32 <= size < 1 << 28 and -1 <= ref < len(lengths) and -1 <= other < len(lengths) and pos >= -1 and other_pos >= -1 and name >= 1 and bases >= 0):
        return None
    if ref >= 0 and pos > lengths[ref] or 32 + name + 4 * ops + (bases + 1) // 2 + bases > size or not stream.has(place, 4 + size):
        return None
    text = stream.get(place + 36, name)
    cigar = struct.unpack(f"<{ops}I", stream.get(place + 36 + name, 4 * ops))
    if text[-1] or not all(33 <= c <= 126 for c in text[:-1]) or any(x & 15 > 8 for x in cigar):
        return None
    return place + 4 + size


def _starts(stream: _Stream, place: int, lengths: list[int]) -> bool:
    at: int | None = place
    for _ in range(_SOUND):
        if not stream.has(at, 1):
            return at != place
        at = _sound(stream, at, lengths)
        if at is None:
            return False
    return True


def bam_records(path: str, start: int, end: int, header: int, lengths: list[int]) -> Iterator[bytes]:
    """Records, without their sizes, that begin in the blocks of a part. header: its unzipped size; lengths: the contigs'.

    A part begins at the first place where several sound records follow each other. Blocks may end within records.
    """
    with open(path, "rb") as file:
        stream = _Stream(_blocks(file, start, end))
        place = 0 if start else header
        if start:
            while stream.has(place, 1) and (stream.end is None or place < stream.end) and not _starts(stream, place, lengths):
                place += 1
        while stream.has(place, 4) and (stream.end is None or place < stream.end):
            size = struct.unpack("<i", stream.get(place, 4))[0]
            if size < 32 or not stream.has(place, 4 + size):
                raise ValueError(f"{path}@{start}: a record doesn't end")
            yield stream.get(place + 4, size)
            place += 4 + size
            stream.forget(place)
