"""Windows of sequences as numbers of two bits a base, and values of windows beside each other, a batch of Arrow rows at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from . import groups

Kernel = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Windows that a task gathers before it counts them.
GATHERED = 1 << 21
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_BASE = np.frombuffer(b"ACGT", np.uint8)


def _rolling(bases: np.ndarray, k: int) -> np.ndarray:
    """The number of the k bases from each place on; the last k - 1 places have none."""
    done, out = 0, np.zeros(len(bases) + 1, np.int64)
    power, size = bases.astype(np.int64), 1
    while True:
        if k & size:  # the bases that are done come first, `size` more after them
            n = max(len(bases) - done - size + 1, 0)
            out = (out[:n] << 2 * size) | power[done : done + n]
            done += size
        if size * 2 > k:
            return out
        n = max(len(power) - size, 0)
        power = (power[:n] << 2 * size) | power[size : size + n]
        size *= 2


#: The four bases of each byte.
_FOUR = np.array([sum(int(_BASE[(i >> 2 * (3 - j)) & 3]) << 8 * j for j in range(4)) for i in range(256)], "<u4")


def text(codes: np.ndarray, k: int) -> pa.Array:
    """Numbers as strings of k bases."""
    words = -(-k // 4)
    out = np.empty((len(codes), words), "<u4")
    for j in range(words):
        out[:, j] = _FOUR[(codes >> 8 * (words - 1 - j)) & 255]
    signs = np.ascontiguousarray(out.view(np.uint8).reshape(len(codes), 4 * words)[:, 4 * words - k :])
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, signs.size + 1, k, dtype=np.int32)), pa.py_buffer(signs))


def flags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, some), ids following each other within a batch, as (first, bits)."""
    for rows in batches:
        if rows.num_rows:
            bits = np.packbits(np.array(rows["some"]).astype(bool)).tobytes()
            yield pa.RecordBatch.from_arrays([rows["id"].slice(0, 1), pa.array([rows.num_rows]), pa.array([bits], pa.binary())], names=["first", "n", "bits"])


#: k-mers are dealt out by so many bits of their number, mixed by an odd factor so that neighbours part.
BUCKETS = 13
_FACTOR = 0x9E3779B97F4A7C15
#: Rows of different k-mers that are handed on at once, about.
EMITTED = 1 << 16


def _packed(codes: np.ndarray, k: int) -> pa.RecordBatch:
    """(bucket, low, high, n): different numbers of k bases, mixed and in halves, and how often each occurs, a row for all of a bucket."""
    mask, bits = np.uint64((1 << 2 * k) - 1), min(BUCKETS, 2 * k)
    mixed = np.sort(codes.astype(np.uint64) * np.uint64(_FACTOR) & mask)
    first = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1])) if len(mixed) else np.zeros(0, np.int64)
    n, mixed = np.diff(np.append(first, len(mixed))), mixed[first]
    ends = np.searchsorted(mixed >> np.uint64(2 * k - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(ends))
    offsets = pa.py_buffer((4 * np.append(ends[some], len(mixed))).astype(np.int32))
    halves = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32), (mixed >> np.uint64(32)).astype(np.uint32), n.astype(np.uint32)
    blocks = [pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(x)]) for x in halves]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *blocks], names=["bucket", "low", "high", "n"])


def cut(k: int, v: int, weighted: bool, table=None) -> Kernel:
    """(key, value, n) of the windows of k + v bases A, C, G and T on both strands of `up`; of the keys whose bit is set, if a
    broadcast table of all keys is given.

    Without weights windows that a task has gathered are counted, and leave it as `_packed` rows where both are one number of up to 31
    bases; else each one has its sequence's weight `n`.
    """

    def counted(keys: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        key, value = np.concatenate(keys), np.concatenate(values)
        if k + v <= 31:
            return _packed(key << 2 * v | value, k + v)
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (value[1:] != value[:-1])))
        return batch(key[first], value[first], pa.array(np.diff(np.append(first, len(key))), pa.int64()))

    def batch(key: np.ndarray, value: np.ndarray, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([text(key, k), text(value, v), n], names=["key", "value", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked = None if table is None else np.unpackbits(np.frombuffer(table.value, np.uint8)).view(bool)
        keys: list[np.ndarray] = []
        values: list[np.ndarray] = []
        for rows in batches:
            own = [s.encode() for s in rows["up"].to_pylist()]
            forward = _CODE[np.frombuffer(b"\n".join(own), np.uint8)]  # a window over a sequence's end has the sign between, which is no base
            for back in (False, True):
                strand = np.where(forward < 4, 3 - forward, 4)[::-1] if back else forward
                wrong = np.concatenate(([0], np.cumsum(strand > 3)))
                at = np.flatnonzero(wrong[k + v :] == wrong[: -(k + v)])
                strand = strand & 3
                key = _rolling(strand, k)[at]
                if picked is not None:
                    some = picked[key]
                    at, key = at[some], key[some]
                value = _rolling(strand, v)[at + k]
                if weighted:
                    start = np.cumsum([0, *(len(s) + 1 for s in own)])
                    row = np.searchsorted(start, len(forward) - (k + v) - at if back else at, "right") - 1
                    yield batch(key, value, rows["n"].take(pa.array(row)))
                else:
                    keys.append(key)
                    values.append(value)
            if sum(map(len, keys)) >= GATHERED:
                yield counted(keys, values)
                keys, values = [], []
        if keys:
            yield counted(keys, values)

    return run


def canonical(k: int) -> Kernel:
    """`_packed` rows of the windows of k bases A, C, G and T of `up`, each the lesser of itself and its reverse complement. Windows that
    a task has gathered are counted, so that a frequent one leaves it once for many.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for rows in batches:
            if not rows.num_rows:
                continue
            forward = _CODE[np.frombuffer(b"\n".join(x.encode() for x in rows["up"].to_pylist()), np.uint8)]
            wrong = np.concatenate(([0], np.cumsum(forward > 3)))
            at = np.flatnonzero(wrong[k:] == wrong[:-k])
            back = (3 - forward[::-1]) & 3
            found.append(np.minimum(_rolling(forward & 3, k)[at], _rolling(back, k)[len(forward) - k - at]))
            if sum(map(len, found)) >= GATHERED:
                yield _packed(np.concatenate(found), k)
                found = []
        if found:
            yield _packed(np.concatenate(found), k)

    return run


def totals(k: int, v: int = 0) -> Kernel:
    """(kmer, n) of `_packed` rows in order of their buckets, those of one k-mer added up; what is held is one bucket. With v, (key,
    value, n) of numbers of k + v bases."""
    mask, back = np.uint64((1 << 2 * (k + v)) - 1), np.uint64(pow(_FACTOR, -1, 1 << 64))

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        mixed, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(mixed)
        mixed = mixed[order]
        first = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1]))
        return mixed[first], np.add.reduceat(n[order], first)

    def batch(done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        mixed, n = (np.concatenate(x) for x in zip(*done))
        found = (mixed * back & mask).astype(np.int64)
        if v:
            return pa.RecordBatch.from_arrays([text(found >> 2 * v, k), text(found & ((1 << 2 * v) - 1), v), pa.array(n)], names=["key", "value", "n"])
        return pa.RecordBatch.from_arrays([text(found, k), pa.array(n)], names=["kmer", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, done, held = -1, [], [], 0
        for rows in batches:
            blocks = [rows[c].to_pylist() for c in ("low", "high", "n")]
            for bucket, *block in zip(rows["bucket"].to_pylist(), *blocks):
                if bucket != last and parts:
                    done.append(added(parts))
                    held += len(done[-1][0])
                    parts = []
                    if held >= EMITTED:
                        yield batch(done)
                        done, held = [], 0
                last = bucket
                low, high, n = (np.frombuffer(x, np.uint32) for x in block)
                parts.append((low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), n.astype(np.int64)))
                if len(parts) >= 1 << 10:
                    parts = [added(parts)]
        if parts:
            done.append(added(parts))
        if done:
            yield batch(done)

    return run


def codes(column: pa.Array, k: int) -> np.ndarray:
    """Strings of k bases A, C, G and T as numbers."""
    out = np.zeros(len(column), np.int64)
    for base in _CODE[_matrix(column, k)].T.astype(np.int64):
        out = out << 2 | base
    return out


def scan(k: int, v: int, best) -> Kernel:
    """(axis, value, num_correct, num_error) of the bases of `seq` up to and with the first that differs from their key's consensus,
    for the keys in best, a broadcast pair of keys in order and their consensus, as numbers; v is at most 26. Axes are those of
    sketch.covariate_rates.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, consensus = best.value
        row_of = np.full(4**k, -1, np.int32)
        row_of[keys] = np.arange(len(keys))
        for rows in groups.chunks(batches, "seq"):
            own = [x.encode("ascii", "replace") for x in rows["seq"].to_pylist()]
            bases = _CODE[np.frombuffer(b"\n".join(own), np.uint8)]
            wrong = np.concatenate(([0], np.cumsum(bases > 3)))
            # A window lies within a read; its key is of bases, its value may hold other signs, which are none of the consensus.
            size = np.fromiter(map(len, own), np.int64, len(own))
            start = np.cumsum(size + 1) - size - 1
            count = np.maximum(size - (k + v) + 1, 0)
            read = np.repeat(np.arange(len(own)), count)
            place = np.arange(len(read)) - (np.cumsum(count) - count)[read]
            at = start[read] + place
            plain = wrong[at + k] == wrong[at]
            read, place, at = read[plain], place[plain], at[plain]
            known = bases & 3
            row = row_of[_rolling(known, k)[at]]
            some = row >= 0
            read, place, at, row = read[some], place[some], at[some], row[some]
            apart = _rolling(known, v)[at + k] ^ consensus[row]
            through = v - (np.frexp(apart.astype(float))[1] + 1) // 2
            strange = np.append(np.flatnonzero(bases > 3), len(bases))
            through = np.minimum(through, strange[np.searchsorted(strange, at + k)] - at - k)
            found: list[tuple[str, np.ndarray, np.ndarray]] = []
            for t in range(1, v + 1):
                there = through >= t - 1
                r, p, right = read[there], place[there] + k + t - 1, (through >= t)[there]
                found += [("pos_start", p + 1, right), ("pos_end", size[r] - p, right)]
                if 3 <= t <= v - 2:
                    q, low = groups.values_at(rows["q"], r, p)
                    found.append(("q", q[q > 0] + low, right[q > 0]))
            for axis in ("q", "pos_start", "pos_end"):
                (value, right), low = (np.concatenate([x[i] for x in found if x[0] == axis] or [np.zeros(0, np.int64)]) for i in (1, 2)), 0
                if len(value):
                    low = int(value.min())
                    (value, right), n = groups.grouped([value - low, right.astype(np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array([axis] * len(n), pa.string()), pa.array((value + low).astype(np.int32)), pa.array(n * right), pa.array(n * (1 - right))], names=["axis", "value", "num_correct", "num_error"])

    return run


def _matrix(column: pa.Array, v: int) -> np.ndarray:
    """The first v signs of each string, a row each; 0 beyond its end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not column.null_count and len(column) and (np.diff(offsets) == v).all():
        own = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        if own.max(initial=0) < 128:
            return own.reshape(-1, v)
    return np.array([x or "" for x in column.to_pylist()], f"U{v}").view(np.uint32).reshape(-1, v)


def compare(value: str, other: str, v: int) -> Kernel:
    """Adds `through`, how many first bases of two columns are the same, and `op`, as functions.edit_label has it; null unless one_edit.

    Values have v bases at most.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            a, b = _matrix(rows[value], v), _matrix(rows[other], v)
            none = np.array(rows[value].is_null()) | np.array(rows[other].is_null())
            same = a == b
            first = lambda wrong: np.where(wrong.any(axis=1), wrong.argmax(axis=1), wrong.shape[1])
            head = first(~same)
            # Bases from j on of one are those from j + 1 on of the other, from the least such j.
            lost = v - 1 - first((a[:, :-1] != b[:, 1:])[:, ::-1])
            put_in = v - 1 - first((a[:, 1:] != b[:, :-1])[:, ::-1])
            swapped = (v - same.sum(axis=1)) == 1
            known = (head < v) & ~none
            at = np.minimum(head, v - 1)
            cases = [(swapped, at, b, ">", a), (lost <= head, lost, b, ">-", None), (put_in <= head, put_in, None, "->", a)]
            op: list[str | None] = [None] * len(a)
            for fits, place, left, sign, right in cases:
                own = np.flatnonzero(known & fits)
                known[own] = False
                before, after = ((x[own, place[own]].tolist() if x is not None else None) for x in (left, right))
                for n, i in enumerate(own.tolist()):
                    op[i] = (chr(before[n]) if before and before[n] else "") + sign + (chr(after[n]) if after and after[n] else "")
            through = np.where(none, 0, head).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(through), pa.array(op, pa.string())], names=[*rows.schema.names, "through", "op"])

    return run
