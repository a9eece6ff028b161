"""Simulated reads: quality tracks from a first-order chain, then an edit drawn at each template base from the error head."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..kernels.walk import encode, gc_bin, revcomp
from ..models.heads import Head
from ..schema import BASES, shifted, window

MAX_INSERTION = 10


@dataclass
class QualityChain:
    """first: chances of the first quality; step: (last, next) chances, over the alphabet."""

    alphabet: tuple[int, ...]
    first: np.ndarray
    step: np.ndarray

    def sample(self, lengths: list[int], rng: np.random.Generator) -> list[np.ndarray]:
        """All reads advance together, position by position."""
        n, longest = len(lengths), max(lengths, default=0)
        out = np.zeros((n, longest), np.int64)
        rows = np.cumsum(self.step, axis=1)
        state = np.searchsorted(np.cumsum(self.first), rng.random(n) * self.first.sum())
        for t in range(longest):
            if t:
                state = (rows[state] < (rng.random(n) * rows[state, -1])[:, None]).sum(axis=1)
            out[:, t] = np.minimum(state, len(self.alphabet) - 1)
        values = np.asarray(self.alphabet)
        return [values[out[i, :k]] for i, k in enumerate(lengths)]


def covariates(template: str, q: np.ndarray, m: int, flank: tuple[int, int], mate: int) -> pd.DataFrame:
    padded = "." * flank[0] + template + "." * flank[1]
    n = len(template)
    at = np.arange(n)
    out = {"q": q.astype(float), "context": [padded[i : i + sum(flank) + 1] for i in range(n)], "pos_start": at + 1, "pos_end": n - at, "mate": mate, "strand": "+-"[mate - 1], "gc": gc_bin(template)}
    for o in window(m)[1:]:
        inside = (at + o >= 0) & (at + o < n)
        out[shifted(o)] = np.where(inside, q[np.clip(at + o, 0, n - 1)], np.nan)
    return pd.DataFrame(out)


def mutate(template: str, q: np.ndarray, log_p: np.ndarray, rng: np.random.Generator, scale: float = 1.0) -> tuple[str, str, str]:
    """(sequence, quality, CIGAR). log_p: (template bases, categories). Before each base insertions are drawn until none comes, then the base's own fate."""
    p = np.exp(log_p)
    p[:, 1:] *= scale
    p[:, 0] = np.maximum(0, 1 - p[:, 1:].sum(axis=1))
    seq, qual, ops = [], [], []
    for t, base in enumerate(template):
        mark = chr(int(q[t]) + 33)
        if base not in BASES:
            seq.append(base), qual.append(mark), ops.append("M")
            continue
        inserted = 0
        while True:
            k = int(np.searchsorted(np.cumsum(p[t]), rng.random() * p[t].sum()))
            if 5 <= k <= 8 and inserted < MAX_INSERTION:
                seq.append(BASES[k - 5]), qual.append(mark), ops.append("I")
                inserted += 1
                continue
            break
        if k >= 9:
            ops.append("D")
            continue
        seq.append(BASES[k - 1] if 1 <= k <= 4 else base), qual.append(mark), ops.append("M")
    return "".join(seq), "".join(qual), encode("".join(ops))


def generate(templates: DataFrame, head: Head, chain: QualityChain, m: int = 1, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """read_id, template, sequence, quality, cigar, mate of every row of templates (read_id, template, mate).

    Each read's random numbers come from (seed, read_id), so a lost task draws the same again.
    """
    shared = templates.sparkSession.sparkContext.broadcast((head, chain))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tracks = shared.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rng = np.random.default_rng([seed, row["read_id"] & 0xFFFFFFFFFFFF])
                template = row["template"].upper()
                q = tracks.sample([len(template)], rng)[0]
                log_p = own.log_probabilities(covariates(template, q, m, own.flank, row["mate"])) if template else np.zeros((0, own.width))
                out.append((row["read_id"], template, *mutate(template, q, log_p, rng, scale), row["mate"]))
            kinds = [pa.int64(), *[pa.string()] * 4, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=["read_id", "template", "sequence", "quality", "cigar", "mate"])

    return templates.select("read_id", "template", "mate").mapInArrow(run, "read_id long, template string, sequence string, quality string, cigar string, mate int")


def insert_sizes(mean: float, sd: float) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and chances of a normal distribution on whole numbers, to four deviations."""
    sizes = np.arange(max(1, int(mean - 4 * sd)), int(mean + 4 * sd) + 1)
    w = np.exp(-0.5 * ((sizes - mean) / max(sd, 1e-9)) ** 2)
    return sizes, w / w.sum()


def fragments(contigs: dict[str, str], n: int, length: int, mean: float, sd: float, adapters: tuple[str, str] = ("", ""), seed: int = 0) -> list[dict]:
    """n pairs of templates; places are uniform over those that fit. A fragment shorter than the read runs into the adapter, then N."""
    rng = np.random.default_rng(seed)
    sizes, chances = insert_sizes(mean, sd)
    names = sorted(contigs)
    room = np.array([[max(0, len(contigs[c]) - s + 1) for c in names] for s in sizes], float) * chances[:, None]
    if not room.sum():
        raise ValueError("no fragment fits a contig")
    out = []
    for i, flat in enumerate(rng.choice(room.size, n, p=(room / room.sum()).ravel())):
        size, name = int(sizes[flat // len(names)]), names[flat % len(names)]
        start = int(rng.integers(len(contigs[name]) - size + 1))
        insert = contigs[name][start : start + size]
        pad = lambda s, a: (s + a + "N" * length)[:length]
        out.append({"name": f"{name}:{start + 1}-{start + size}#{i}", "r1": pad(insert, adapters[0]), "r2": pad(revcomp(insert), adapters[1])})
    return out
