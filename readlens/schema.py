"""Names and values that count tables may use, fixed for the whole engine."""

from __future__ import annotations

import re

BASES = "ACGT"
PHRED_OFFSET = 33
MAX_QUALITY = 93
UNITS = ("base", "value", "read", "error")
FIELDS = frozenset("op indel indel_length context locus q t pos_start pos_end strand mate gc length run read latent tile contig site allele".split())
_SHIFTED = re.compile(r"q_[mp][1-9]\d*\Z")

#: Labels of an edit: a match, what can't be told, substitutions, insertions, deletions.
OPS = frozenset({"=", "!"} | {f"{a}>{b}" for a in BASES for b in BASES if a != b} | {f"->{b}" for b in BASES} | {f"{b}>-" for b in BASES})
#: Categories of the error head: match, to a base, insertion of a base, deletion.
CATEGORIES = ("=", ">A", ">C", ">G", ">T", "->A", "->C", "->G", "->T", "-")


def known_field(name: str) -> bool:
    return name in FIELDS or bool(_SHIFTED.match(name))


def shifted(offset: int) -> str:
    """The column of the quality so many bases away: q, q_m1 (one before), q_p2 (two after)."""
    return "q" if not offset else f"q_m{-offset}" if offset < 0 else f"q_p{offset}"


def window(m: int) -> list[int]:
    """Offsets of a two-sided window of qualities: 0, -1, 1, -2, 2 ..."""
    return [0] + [o for k in range(1, m + 1) for o in (-k, k)]
