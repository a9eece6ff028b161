"""Populations of related haplotypes: substitutions and indels at a chosen identity, minor alleles, abundances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..schema import BASES

_TRANSITION = {"A": "G", "G": "A", "C": "T", "T": "C"}


@dataclass(frozen=True)
class Rules:
    ti_tv: float = 2.0
    indel_fraction: float = 0.1
    max_indel: int = 6
    minor_frequency: tuple[float, float] = (0.01, 0.5)


def mutated(seq: str, divergence: float, rng: np.random.Generator, rules: Rules = Rules()) -> str:
    """seq with edits at a rate; transitions are ti_tv times as frequent as transversions."""
    out: list[str] = []
    skip = 0
    for base in seq:
        if skip:
            skip -= 1
            continue
        if base not in BASES or rng.random() >= divergence:
            out.append(base)
        elif rng.random() < rules.indel_fraction:
            size = int(rng.integers(1, rules.max_indel + 1))
            if rng.random() < 0.5:
                skip = size - 1
            else:
                out += [base, *rng.choice(list(BASES), size)]
        elif rng.random() < rules.ti_tv / (1 + rules.ti_tv):
            out.append(_TRANSITION[base])
        else:
            out.append(str(rng.choice([b for b in BASES if b not in (base, _TRANSITION[base])])))
    return "".join(out)


def haplotypes(root: str, n: int, identity: float, shape: str = "star", seed: int = 0, rules: Rules = Rules()) -> list[str]:
    """n haplotypes, each about (1 - identity) / 2 away from the root, however they are related.

    star: all are mutated from the root by themselves. tree: a random tree, all tips equally deep; what a branch changes all
    tips beyond it have, so haplotypes are pairwise as alike as `identity` or more.
    """
    rng = np.random.default_rng(seed)
    if shape not in ("star", "tree"):
        raise ValueError(f"unknown shape {shape!r}")
    depth = (1 - identity) / 2
    if shape == "star":
        return [mutated(root, depth, rng, rules) for _ in range(n)]
    out = [""] * n
    open_ = [(root, depth, list(range(n)))]
    while open_:
        seq, left, tips = open_.pop()
        if len(tips) == 1:
            out[tips[0]] = mutated(seq, left, rng, rules)
            continue
        down = left * rng.uniform(0.2, 0.8)
        own = mutated(seq, down, rng, rules)
        mixed = rng.permutation(tips).tolist()
        at = int(rng.integers(1, len(tips)))
        open_ += [(own, left - down, mixed[at:]), (own, left - down, mixed[:at])]
    return out


def sites(a: str, b: str) -> list[tuple[int, str, str]]:
    """(0-based place, allele of a, allele of b) of haplotypes of equal length."""
    if len(a) != len(b):
        raise ValueError("haplotypes with indels are aligned first")
    return [(i, x, y) for i, (x, y) in enumerate(zip(a, b)) if x != y]


def minor_alleles(seq: str, n: int, seed: int = 0, rules: Rules = Rules()) -> list[tuple[int, str, float]]:
    """n places with a minor allele, its frequency log-uniform between the rules' bounds."""
    rng = np.random.default_rng(seed)
    low, high = np.log(rules.minor_frequency)
    out = []
    for at in sorted(rng.choice(len(seq), n, replace=False).tolist()):
        out.append((at, str(rng.choice([b for b in BASES if b != seq[at]])), float(np.exp(rng.uniform(low, high)))))
    return out


def abundances(n: int, evenness: float = 1.0, seed: int = 0) -> np.ndarray:
    """Shares of n haplotypes, from a Dirichlet distribution; the greater the evenness, the more alike."""
    return np.random.default_rng(seed).dirichlet(np.full(n, evenness))


def identity(a: str, b: str) -> float:
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b), 1)
