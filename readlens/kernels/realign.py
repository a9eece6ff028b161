"""Affine-gap alignment of a read to a template, in rows of numpy, within a band that is widened until it is safe."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from .walk import encode, parts, revcomp

#: Less than any score, and twice of it still fits.
_FAR = -(1 << 29)


@dataclass(frozen=True)
class Scores:
    match: int = 2
    mismatch: int = -4
    open: int = -4
    extend: int = -2


@dataclass(frozen=True)
class Alignment:
    """score; the first and one past the last template place used; CIGAR over those; read bases inserted behind the last one."""

    score: int
    start: int
    end: int
    cigar: str
    after: int


def align(template: str, read: str, scores: Scores = Scores(), free_ends: bool = False, band: int = 64) -> Alignment:
    """free_ends: template bases before and after the read cost nothing.

    Cells further than a band from the diagonals that gapless alignments use are left out. A way through them has gaps so
    long that its score is bounded; unless what was found is better than that bound, the band is doubled, so the result is
    the best of all. Where scores tie, matches go last, so gaps are as far left as they go, and gaps stay whole.
    """
    a, b = np.frombuffer(template.encode(), np.uint8), np.frombuffer(read.encode(), np.uint8)
    n, m = len(a), len(b)
    while True:
        found = _banded(a, b, scores, free_ends, band)
        if band >= max(n, m) or (found and found.score > scores.match * min(n, m) + scores.open + scores.extend * (band + 1)):
            return found
        band *= 2


class _Rows:
    """Rows of the three tables within the band. Row i holds columns first(i) to first(i) + width, before and behind which nothing is."""

    def __init__(self, a: np.ndarray, b: np.ndarray, scores: Scores, free_ends: bool, band: int) -> None:
        self.a, self.b, self.scores, self.free = a, b, scores, free_ends
        n, m = len(a), len(b)
        self.below, self.above = max(0, n - m) + band, max(0, m - n) + band
        self.width = min(m + 1, self.below + self.above + 1)
        self.steps = (scores.extend * np.arange(self.width)).astype(np.int32)
        self.top = m + 1 - self.width

    def first(self, i: int) -> int:
        return min(max(0, i - self.below), self.top)

    def next(self, i: int, best: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best, gone, more) of row i from row i - 1: a deletion moves down a column, an insertion along the row, where it is linear
        in its length, so that a running maximum gives it."""
        s, low = self.scores, self.first(i)
        row = np.full(self.width, _FAR, np.int32)
        if low == 0 and (i == 0 or self.free):
            row[0] = 0
        new = np.full(self.width, _FAR, np.int32)
        if i:
            moved = low - self.first(i - 1)
            kept = slice(moved, self.width)
            new[: self.width - moved] = np.maximum(best[kept] + s.open, gone[kept]) + s.extend
            # The cell diagonally before column low + k stands at k - 1 + moved in the last row.
            first, before = 1 - moved, best[: self.width - 1 + moved]
            bases = self.b[low + first - 1 : low + first - 1 + len(before)]
            row[first : first + len(before)] = before + np.where(bases == self.a[i - 1], s.match, s.mismatch).astype(np.int32)
            row = np.maximum(row, new)
        reach = np.maximum.accumulate(row - self.steps)
        more = np.full(self.width, _FAR, np.int32)
        more[1:] = reach[:-1] + s.open + self.steps[1:]
        return np.maximum(row, more), new, more


def _banded(a: np.ndarray, b: np.ndarray, scores: Scores, free_ends: bool, band: int) -> Alignment | None:
    """The best alignment within a band; None where no way leads through it.

    Only every so-manieth row is kept; on the way back the rows between two of them are made once more.
    """
    rows = _Rows(a, b, scores, free_ends, band)
    n, m = len(a), len(b)
    each = max(1, int((n + 1) ** 0.5))
    kept, ends = {}, np.full(n + 1, _FAR, np.int64)
    best = gone = np.full(rows.width, _FAR, np.int32)
    for i in range(n + 1):
        if i and (i - 1) % each == 0:
            kept[i - 1] = best, gone
        best, gone, _ = rows.next(i, best, gone)
        if rows.first(i) + rows.width > m:
            ends[i] = best[m - rows.first(i)]
    end = int(ends.argmax()) if free_ends else n
    score = int(ends[end])
    if score <= _FAR // 2:
        return None
    made: dict[int, tuple] = {}

    def table(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in made:
            start = ((i - 1) // each) * each if i else 0
            if i:
                best_, gone_ = kept[start]
            else:
                best_ = gone_ = np.full(rows.width, _FAR, np.int32)
            for old in [k for k in made if k > i + 1]:
                del made[old]
            if i == 0:
                made[0] = rows.next(0, best_, gone_)
            for k in range(start + 1, i + 1):
                made[k] = rows.next(k, best_, gone_)
                best_, gone_ = made[k][:2]
        return made[i]

    def cell(which: int, i: int, j: int) -> int:
        at = j - rows.first(i)
        return int(table(i)[which][at]) if 0 <= at < rows.width else _FAR

    i, j, state, ops = end, m, "M", []
    while j or (i and not free_ends):
        if state == "M":
            if i and j and cell(0, i, j) == cell(0, i - 1, j - 1) + (scores.match if a[i - 1] == b[j - 1] else scores.mismatch):
                ops.append("M")
                i, j = i - 1, j - 1
            else:
                state = "D" if i and cell(0, i, j) == cell(1, i, j) else "I"
        elif state == "D":
            ops.append("D")
            state = "D" if cell(1, i, j) == cell(1, i - 1, j) + scores.extend else "M"
            i -= 1
        else:
            ops.append("I")
            state = "I" if j > 1 and cell(2, i, j) == cell(2, i, j - 1) + scores.extend else "M"
            j -= 1
    ops.reverse()
    after = 0
    while ops and ops[-1] == "I":
        ops.pop()
        after += 1
    return Alignment(score, i, end, encode("".join(ops)), after)


#: Cells of the tables of one run of `align_many`.
CELLS = 1 << 22


def align_many(templates: list[str], reads: list[str], scores: Scores = Scores(), band: int = 8) -> list[Alignment]:
    """`align` of each read to its template from end to end; pairs of the same lengths go through the rows of the tables together.

    The band starts narrow: pairs for which it turns out not to be safe are taken again with a band of twice the width.
    """
    found: list[Alignment | None] = [None] * len(reads)
    sizes: dict[tuple[int, int], list[int]] = {}
    for k, (template, read) in enumerate(zip(templates, reads)):
        sizes.setdefault((len(template), len(read)), []).append(k)
    for (n, m), open_ in sizes.items():
        width = band
        while open_:
            columns = min(m + 1, abs(n - m) + 2 * width + 1)
            if (n + 1) * columns > CELLS:  # a pair that fills a run alone: rows of it are made anew on the way back
                for k in open_:
                    found[k] = align(templates[k], reads[k], scores, band=width)
                break
            unsafe = []
            step = max(1, CELLS // ((n + 1) * columns))
            for at in range(0, len(open_), step):
                some = open_[at : at + step]
                a, b = (np.frombuffer("".join(texts[k] for k in some).encode(), np.uint8).reshape(len(some), size) for texts, size in ((templates, n), (reads, m)))
                made = _banded_many(a, b, scores, width)
                for k, own in zip(some, made):
                    if width >= max(n, m) or own.score > scores.match * min(n, m) + scores.open + scores.extend * (width + 1):
                        found[k] = own
                    else:
                        unsafe.append(k)
            open_, width = unsafe, width * 2
    return found


def _banded_many(a: np.ndarray, b: np.ndarray, scores: Scores, band: int) -> list[Alignment]:
    """The best alignments of pairs within a band, (pairs, n) and (pairs, m), as `_banded` gives them; the tables are kept as choices of one byte."""
    (count, n), m = a.shape, b.shape[1]
    below, above = max(0, n - m) + band, max(0, m - n) + band
    width = min(m + 1, below + above + 1)
    first = [min(max(0, i - below), m + 1 - width) for i in range(n + 1)]
    steps = (scores.extend * np.arange(width)).astype(np.int32)
    # Bits of a cell: 1 best by a match, 2 best by a deletion, 4 the deletion came from one, 8 the insertion came from one.
    choices = np.zeros((n + 1, count, width), np.uint8)
    best = gone = np.full((count, width), _FAR, np.int32)
    for i in range(n + 1):
        row = np.full((count, width), _FAR, np.int32)
        new = np.full((count, width), _FAR, np.int32)
        diagonal = np.full((count, width), 2 * _FAR, np.int32)
        bits = choices[i]
        if i == 0:
            row[:, 0] = 0
        else:
            moved = first[i] - first[i - 1]
            new[:, : width - moved] = np.maximum(best[:, moved:] + scores.open, gone[:, moved:]) + scores.extend
            bits[:, : width - moved] |= (new[:, : width - moved] == gone[:, moved:] + scores.extend).view(np.uint8) << 2
            left, before = 1 - moved, best[:, : width - 1 + moved]
            bases = b[:, first[i] + left - 1 : first[i] + left - 1 + before.shape[1]]
            diagonal[:, left : left + before.shape[1]] = before + np.where(bases == a[:, i - 1 : i], scores.match, scores.mismatch).astype(np.int32)
            row = np.maximum(np.maximum(row, diagonal), new)
        more = np.full((count, width), _FAR, np.int32)
        more[:, 1:] = np.maximum.accumulate(row - steps, axis=1)[:, :-1] + scores.open + steps[1:]
        best, gone = np.maximum(row, more), new
        bits |= (best == diagonal).view(np.uint8) | (best == new).view(np.uint8) << 1
        bits[:, 1:] |= (more[:, 1:] == more[:, :-1] + scores.extend).view(np.uint8) << 3
    score = best[:, m - first[n]]
    # All pairs walk back together, one choice a turn: state 0 is the best of all, 1 a deletion, 2 an insertion.
    pair, state = np.arange(count if n + m else 0), np.zeros(count, np.uint8)
    i, j, at = np.full(count, n), np.full(count, m), np.full(count, n + m)
    ops = np.zeros((count, n + m), np.uint8)
    low = np.array(first)
    while len(pair):
        cell = choices[i, pair, j - low[i]]
        match = (state == 0) & (i > 0) & (j > 0) & (cell & 1 > 0)
        turn = (state == 0) & ~match
        state[turn] = np.where((i[turn] > 0) & (cell[turn] & 2 > 0), 1, 2)
        down, along = state == 1, state == 2
        at -= 1
        ops[pair, at] = np.where(match, ord("M"), np.where(down, ord("D"), ord("I")))
        state[down & (cell & 4 == 0)] = 0
        state[along & ~((j > 1) & (cell & 8 > 0))] = 0
        i, j = i - (match | down), j - (match | along)
        left = (i > 0) | (j > 0)
        pair, state, i, j, at = pair[left], state[left], i[left], j[left], at[left]
    out = []
    for own, total in zip(ops, score.tolist()):
        way = own[own > 0].tobytes().decode()
        kept = way.rstrip("I")
        out.append(Alignment(total, 0, n, encode(kept), len(way) - len(kept)))
    return out


def align_forward(window: str, read: str, reverse: bool, scores: Scores = Scores()) -> tuple[Alignment, int, int]:
    """A read within a window of the forward strand, template ends free: the alignment in the read's own direction, and how many
    bases of its start and of its end are clipped. The alignment's start and end are the window's.

    Ties are broken on the forward strand, as aligners do, whichever strand the read is from. Bases put in behind the forward
    strand's last base are clipped, and so are those that end the read once it is turned.
    """
    found = align(window, revcomp(read) if reverse else read, scores, free_ends=True)
    if not reverse:
        return replace(found, after=0), 0, found.after
    turned, behind = parts(found.cigar)[::-1], 0
    if turned and turned[-1][1] == "I":
        behind = turned.pop()[0]
    return replace(found, cigar="".join(f"{k}{op}" for k, op in turned), after=0), found.after, behind


def end_to_end(reference: str, start: int, end: int, read: str, before: int, behind: int, margin: int = 16, max_divergence: float = 0.5, min_clip: int = 8, scores: Scores = Scores()) -> tuple[Alignment, int] | None:
    """A soft-clipped read aligned whole: (alignment, its window's start), or None where a clipped end turns out to be other sequence.

    The read's `before` first and `behind` last bases were clipped; start and end are the span of the rest. An end of
    min_clip bases or more may have edits for max_divergence of them at most.
    """
    low, high = max(0, start - before - margin), min(len(reference), end + behind + margin)
    found = align(reference[low:high], read, scores, free_ends=True)
    t, r, edits_before, edits_behind = low + found.start, 0, 0, found.after
    for n, op in parts(found.cigar):
        for _ in range(n):
            edit = op != "M" or reference[t] != read[r]
            edits_before += edit and r < before
            edits_behind += edit and r >= len(read) - behind
            t += op != "I"
            r += op != "D"
    for clipped, edits in ((before, edits_before), (behind, edits_behind)):
        if clipped >= min_clip and edits > max_divergence * clipped:
            return None
    return found, low
