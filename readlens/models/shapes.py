"""What margins of a sketch add to the error head, in shape alone: by place in the read, by strand, by GC; and its levels.

Inputs are small tables (a row of a place, a label, a bin or a value length), which are gathered.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from ..operators import sketch
from ..schema import CATEGORIES
from .heads import Head, hats
from .spec import Component

LEVELS = ("skiver", "ols", "kvmer", "position")
BETAS = (1.0, 0.95, 0.9, 0.85, 0.8)
RIDGE = 1e-6


def _logit(rate: np.ndarray) -> np.ndarray:
    r = np.clip(rate, 1e-9, 1 - 1e-9)
    return np.log(r / (1 - r))


def _curve(basis: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the basis in a weighted ridge regression with an intercept, which is left out of them."""
    x = np.column_stack((basis, np.ones(len(basis))))
    return np.linalg.solve((x * weight[:, None]).T @ x + RIDGE * np.eye(x.shape[1]), x.T @ (weight * target))[:-1]


def _on_errors(shift: np.ndarray) -> np.ndarray:
    """(slots, categories): a shift of log-odds on every category but the match."""
    out = np.repeat(shift[:, None], len(CATEGORIES), axis=1)
    out[:, 0] = 0
    return out


def _hat_matrix(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    at, w = hats(x, knots)
    out = np.zeros((len(x), len(knots)))
    np.add.at(out, (np.arange(len(x))[:, None], at), w)
    return out


def position(rows: DataFrame, lengths: DataFrame, knots: int = 4) -> Component:
    """Curves over the distances from both ends, fitted together to error rates by either, weighted by errors and centred.

    A base so far from one end lies, over the reads that reach it, at several distances from the other; that end's basis is
    averaged over them. rows: index, from_start, num_correct, num_error; lengths: length, n. No rows, or no reads, raise.
    """
    table, found = rows.toArrow().to_pandas(), lengths.toArrow().to_pandas()
    if not len(table) or not found["n"].sum():
        raise ValueError("curves by position need rates by position and the reads' lengths")
    longest = int(found["length"].max())
    top = max(longest, int(table["index"].max()), 2)
    reads = np.zeros(longest + 1)
    np.add.at(reads, found["length"].to_numpy(int), found["n"].to_numpy(float))
    places = np.linspace(0.0, math.log(top), knots)
    basis = _hat_matrix(np.log(np.arange(1, top + 1)), places)
    own, weight = table["index"].to_numpy(int), table["num_error"].to_numpy(float)
    other = np.zeros((len(table), knots))
    for i, d in enumerate(own):
        if d <= longest and (w := reads[d:]).sum():
            other[i] = w @ basis[: longest - d + 1] / w.sum()
    near = basis[np.minimum(own, top) - 1]
    start = table["from_start"].to_numpy(bool)[:, None]
    both = np.concatenate((np.where(start, near, other), np.where(start, other, near)), axis=1)
    b = _curve(both, _logit(weight / np.maximum(weight + table["num_correct"].to_numpy(float), 1)), weight)
    if weight.sum():
        b[:knots] -= np.average(both @ b, weights=weight)
    return Component(f"Position({knots})", {"knots": places, "start": _on_errors(b[:knots]), "end": _on_errors(b[knots:])}, meta={"shape": "rates by position"})


def strand(rows: DataFrame) -> Component:
    """Half the log-odds between strands on either, by category, half an event added to each; strands are taken to be read equally. rows: op, forward, total."""
    table = rows.toArrow().to_pandas()
    counts = np.full((2, len(CATEGORIES)), 0.5)
    kinds = Head._categories(table["op"])
    np.add.at(counts[0], kinds, table["forward"].to_numpy(float))
    np.add.at(counts[1], kinds, (table["total"] - table["forward"]).to_numpy(float))
    delta = np.log(counts[1] / counts[0])
    delta[0] = 0
    return Component("Strand", {"weights": np.stack((-delta / 2, delta / 2))}, meta={"shape": "errors by strand"})


def gc(rows: DataFrame, knots: int = 3) -> Component:
    """A curve over GC bins' middles, weighted by errors and centred. rows: lo, hi, rate, num_error. Bins without errors don't count; none with raises."""
    table = rows.filter("num_error > 0").toArrow().to_pandas()
    if not len(table):
        raise ValueError("no GC bin has errors")
    places = np.linspace(0.0, 100.0, knots)
    basis = _hat_matrix((table["lo"].to_numpy(float) + table["hi"].to_numpy(float)) / 2, places)
    weight = table["num_error"].to_numpy(float)
    b = _curve(basis, _logit(table["rate"].to_numpy(float)), weight)
    b -= np.average(basis @ b, weights=weight)
    return Component(f"GC({knots})", {"knots": places, "weights": _on_errors(b)}, meta={"shape": "rates by GC"})


def refit(hazard: DataFrame) -> dict[str, Any]:
    """The hazards' level without a penalty: a line through log(-log(1 - h)) over log t, read at t = 1, with two standard errors of its slope
    either way, and with slopes pinned. hazard: t, hazard. Fewer than three usable points raise."""
    table = sketch.hazard_window(hazard, "hazard").toArrow().to_pandas().sort_values("t")
    if len(table) < 3:
        raise ValueError(f"{len(table)} hazards are too few for a line")
    x, y = np.log(table["t"].to_numpy(float)), np.log(-np.log1p(-table["hazard"].to_numpy(float)))
    slope, intercept = np.polyfit(x, y, 1)
    left = y - slope * x - intercept
    error = math.sqrt(left @ left / (len(x) - 2) / ((x - x.mean()) @ (x - x.mean())))

    def level(rate: float) -> float:
        return 1 - math.exp(-rate)

    def pinned(beta: float) -> float:
        return level(math.exp(float((y - (beta - 1) * x).mean())) / beta)

    beta = float(slope) + 1
    return {
        "points": len(x), "beta": beta, "beta_se": error, "per_base_rate": level(math.exp(intercept) / beta),
        "band": sorted(pinned(beta + s * 2 * error) for s in (-1, 1)), "pinned": {f"{b:.2f}": pinned(b) for b in BETAS},
    }


def levels(hazard: DataFrame, rows: DataFrame, positions: DataFrame, rate: float, use_all: bool = False) -> dict[str, dict[str, Any]]:
    """Every level that a sketch can state, beside the run's own rate."""
    found = {"skiver": {"per_base_rate": rate}, "ols": refit(hazard), "kvmer": sketch.kvmer_level(rows, use_all).first().asDict(), "position": sketch.position_level(positions).first().asDict()}
    return {k: v | {"ratio": (v["per_base_rate"] or math.nan) / rate} for k, v in found.items()}


def level_ratio(found: dict[str, dict[str, Any]], source: str) -> float:
    """What to multiply the run's rates by to give them a source's level."""
    if source not in LEVELS:
        raise ValueError(f"a level is one of {', '.join(LEVELS)}")
    return found[source]["ratio"]
