"""Lengths of insertions and deletions: a softmax over lengths 1 to n by kind, homopolymer run and quality, penalised like the heads.

Events are added up by Spark; their covariates have two kinds, eight runs and the alphabet's qualities, so few rows are left.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import newton
from .heads import Design, Penalised, Penalty, softmax
from .spec import Component, SpecError, Token

KINDS = ("I", "D")
#: Longer homopolymer runs count as this.
LONGEST_RUN = 8


def _length(token: str) -> int:
    t = Token.of(token, "E")
    if t.name != "IndelLength" or len(t.args) != 1 or t.args[0] < 1:
        raise SpecError(f"{token} isn't IndelLength(n) of a length n")
    return t.args[0]


def _gathered(events: DataFrame, alphabet: Sequence[int], longest: int) -> tuple[pd.DataFrame, np.ndarray]:
    """(indel, run, q) rows and their counts by length. Longer lengths and runs count as the longest."""
    own = events.groupBy("indel", F.least("run", F.lit(LONGEST_RUN)).alias("run"), "q", F.least("indel_length", F.lit(longest)).alias("length")).agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if (unknown := set(own["q"]) - set(alphabet)) or set(own["indel"]) - set(KINDS):
        raise SpecError(f"a quality isn't in the alphabet, or a kind isn't I or D: {sorted(map(str, unknown))}")
    rows = own[["indel", "run", "q"]].drop_duplicates(ignore_index=True)
    place = own[["indel", "run", "q"]].merge(rows.assign(__row=np.arange(len(rows))), how="left")["__row"].to_numpy(int)
    counts = np.zeros((len(rows), longest))
    np.add.at(counts, (place, own["length"].to_numpy(int) - 1), own["n"].to_numpy(float))
    return rows, counts


def _places(rows: pd.DataFrame, alphabet: Sequence[int]) -> np.ndarray:
    """Slots of kind, of run and of quality, each within its kind."""
    kind = rows["indel"].map(KINDS.index).to_numpy(int)
    run = np.minimum(rows["run"].to_numpy(int), LONGEST_RUN) - 1
    q = rows["q"].map({v: i for i, v in enumerate(alphabet)}).to_numpy(int)
    return np.stack((kind, 2 + kind * LONGEST_RUN + run, 2 + 2 * LONGEST_RUN + kind * len(alphabet) + q), axis=1)


def fit(events: DataFrame, token: str, alphabet: Sequence[int], l2: float = 1.0) -> Component:
    """events: indel (I or D), indel_length, run, q and n, as `alignments.indel_events` gives them. Without events all lengths are as likely."""
    longest = _length(token)
    rows, counts = _gathered(events, alphabet, longest)
    places = _places(rows, alphabet)
    size = 2 * (1 + LONGEST_RUN + len(alphabet))
    objective = Penalised(Design(places, np.ones(places.shape), None, counts), Penalty(l2), size, longest, 0, None, False)
    theta = newton.minimise(objective, np.zeros(size * longest), tolerance=1e-9).x.reshape(size, longest)
    bias, run, q = np.split(theta, [2, 2 + 2 * LONGEST_RUN])
    return Component(token, {"bias": bias, "run": run.reshape(2, LONGEST_RUN, longest), "q": q.reshape(2, len(alphabet), longest)}, meta={"max_run": LONGEST_RUN})


def probabilities(component: Component, rows: pd.DataFrame, alphabet: Sequence[int]) -> np.ndarray:
    """(rows, lengths). rows: indel, run and q."""
    theta = np.concatenate([component.arrays[k].reshape(-1, component.arrays["bias"].shape[1]) for k in ("bias", "run", "q")])
    places = _places(rows, alphabet)
    return softmax(theta, places, np.ones(places.shape), None)[0]


def log_likelihood(component: Component, events: DataFrame, alphabet: Sequence[int]) -> float:
    rows, counts = _gathered(events, alphabet, _length(component.token))
    return float((counts * np.log(probabilities(component, rows, alphabet))).sum())
