"""Where byte-level BPE splits a text before merging, found by transition-function scans instead of a regex.

Each codepoint becomes a class; each class is a function from the scanner's state to its next state. Functions compose
associatively, so a long text is cut into blocks, the blocks' functions are scanned by doubling, and then all blocks are
walked side by side from their known entry states. The rule is the one that `public_tokenizers.PATTERN` states:
contractions, then runs of letters, of numbers or of other visible signs with one blank before them, then white space of
which the last sign stands apart if something visible follows.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from . import textvec

# Classes of codepoints. SPACE and WHITE are the last white space before a visible sign; GAP is any other white space.
LETTER, NUMBER, OTHER, GAP, SPACE, WHITE, SHORT, LONG, STOP = range(9)
# States: what the scanner has just read. ONE_LEFT and TWO_LEFT stand within a contraction.
FRESH, JOIN, LETTERS, NUMBERS, OTHERS, BLANKS, ONE_LEFT, TWO_LEFT = range(8)

# Fixed values of the format: white space of the pattern's \s, and the letters of its contractions.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ONE_LETTER = "stmd"
_TWO_LETTERS = ("re", "ve", "ll")

BLOCK = 128


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a slice starts), both by class and state."""
    goes = np.empty((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    for kind, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
        goes[kind] = run
        starts[kind, [JOIN, run]] = False
    goes[LETTER, TWO_LEFT], goes[LETTER, ONE_LEFT] = ONE_LEFT, FRESH
    starts[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    for kind, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):  # an apostrophe within a run of signs is one of them
        goes[kind] = left
        goes[kind, [JOIN, OTHERS]] = OTHERS
        starts[kind, [JOIN, OTHERS]] = False
    goes[GAP] = BLANKS
    starts[GAP, BLANKS] = False
    goes[SPACE], goes[WHITE], goes[STOP] = JOIN, FRESH, FRESH
    return goes, starts


_GOES, _STARTS = (bytes(np.resize(np.append(x.ravel(), np.zeros(256, x.dtype)), 256).astype(np.uint8)) for x in _machine())


def _look_up(table: bytes, symbols: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A byte table at class * 8 + state."""
    places = (symbols << 3) | states
    return np.frombuffer(places.tobytes().translate(table), np.uint8).reshape(places.shape)


@cache
def _classes() -> np.ndarray:
    by_letter = np.full(256, OTHER, np.uint8)
    by_letter[ord("L")], by_letter[ord("N")] = LETTER, NUMBER
    out = by_letter[textvec.categories()]
    out[_WHITE_SPACE] = GAP
    out[textvec.END] = STOP
    return out


def _symbols(cp: np.ndarray) -> np.ndarray:
    kinds = _classes()[cp]
    blank = np.flatnonzero(kinds == GAP)
    blank = blank[(kinds[blank + 1] != GAP) & (kinds[blank + 1] != STOP)]  # the array ends with STOP
    kinds[blank] = np.where(cp[blank] == 0x20, SPACE, WHITE)
    marks = np.flatnonzero(cp == ord("'"))
    if len(marks):
        padded = np.append(cp[-1:], 0)
        one = cp[marks + 1]
        two = np.where(marks + 2 < len(cp), cp[np.minimum(marks + 2, len(cp) - 1)], padded[0])
        kinds[marks[np.isin(one, [ord(c) for c in _ONE_LETTER])]] = SHORT
        for a, b in _TWO_LETTERS:
            kinds[marks[(one == ord(a)) & (two == ord(b))]] = LONG
    return kinds


def _entry_states(blocks: np.ndarray) -> np.ndarray:
    """The state in which each block is entered, by an inclusive scan over the blocks' composed functions."""
    n = blocks.shape[1]
    function = np.repeat(np.arange(8, dtype=np.uint8)[:, None], n, axis=1)
    for row in blocks:
        function = _look_up(_GOES, row, function)
    function = function.copy()
    reach = 1
    while reach < n:
        function[:, reach:] = np.take_along_axis(function[:, reach:], function[:, :-reach].astype(np.intp), axis=0)
        reach *= 2
    return np.concatenate((np.array([FRESH], np.uint8), function[FRESH, :-1]))


def slice_starts(cp: np.ndarray) -> np.ndarray:
    """Places where a slice starts in texts joined by `textvec.codepoints`; each END is a slice of its own."""
    kinds = _symbols(cp)
    padded = np.full(-(-len(kinds) // BLOCK) * BLOCK, STOP, np.uint8)
    padded[: len(kinds)] = kinds
    blocks = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
    state = _entry_states(blocks)
    begins = np.empty(blocks.shape, bool)
    for i, row in enumerate(blocks):
        begins[i] = _look_up(_STARTS, row, state)
        state = _look_up(_GOES, row, state)
    return np.flatnonzero(begins.T.ravel()[: len(kinds)])


def slices(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All slices of the texts in order, and offsets of each text's."""
    joined = "\ud800".join(texts) + "\ud800"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = slice_starts(cp)
    closing = np.flatnonzero(cp[starts] == textvec.END)
    keep = np.ones(len(starts), bool)
    keep[closing] = False
    stops = np.append(starts[1:], len(cp))[keep]
    found = list(map(joined.__getitem__, map(slice, starts[keep].tolist(), stops.tolist())))
    return found, np.concatenate(([0], closing - np.arange(len(closing))))
