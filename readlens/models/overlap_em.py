"""Both heads from mate overlaps: where mates differ, which of them is right is weighed by how likely the other's error is.

Disputes stay in Spark. A turn scores their rows with the heads of the last one, adds the logarithms up by dispute, and fits
the error head to the counts that follow; only sums by covariates and weights are gathered. Disputes whose mates' calls have the
same covariates are a set: as long as one machine can fit so many sets, a turn is one pass over the disputes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import category
from ..operators import overlap
from ..operators.bases import base_counts
from ..session import Stages
from ..table import counted
from . import spread
from .heads import MAX_ROWS, Head, Penalty
from .spec import ModelSpec

#: Categories that gapless overlaps don't show: insertions and the deletion.
_UNSEEN = slice(5, None)


#: An impossible call is so far off that no sum of others makes up for it, and two of them cancel.
_OFF = -1e6


def call_gaps(rows: DataFrame, keys: list[str], error: Head) -> DataFrame:
    """(keys, gap): how much likelier both mates' calls are if mate 1 is right, as a logarithm. rows: keys and the `rows` of a dispute."""
    side = F.when(F.col("i") < 2, 1).otherwise(-1)
    own = rows.select(*keys, F.posexplode("rows").alias("i", "r")).select(*keys, side.alias("side"), "r.*")
    calls = spread.scored(own, error).select(*keys, "side", F.get("logp", category(F.col("op"))).alias("x"))
    return calls.groupBy(*keys).agg(F.sum(F.col("side") * F.greatest("x", F.lit(_OFF))).alias("gap"))


def quality_gaps(disputes: DataFrame, quality: Head) -> DataFrame:
    """(dispute, gap): the same of the qualities around the base, given what then is the base."""
    around = [disputes.select("dispute", F.lit(s).alias("side"), F.explode(c).alias("r")).select("dispute", "side", "r.*") for s, c in ((1, "first"), (-1, "second"))]
    place = F.array_position(F.lit(list(quality.alphabet)), F.col("q")).cast("int") - 1
    scored = spread.scored(around[0].unionByName(around[1]), quality).select("dispute", "side", F.get("logp", place).alias("x"))
    return scored.groupBy("dispute").agg(F.sum(F.col("side") * F.greatest("x", F.lit(_OFF))).alias("gap"))


def chance(gap: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(gap, F.lit(500.0)), F.lit(-500.0))))


def first_right(disputes: DataFrame, error: Head, quality: Head | None = None) -> DataFrame:
    """(dispute, right): the chance that mate 1 is right. disputes: `overlap.disputes` with an id of each, `dispute`.

    Either explanation has the chances of both mates' calls, and with a quality head those of the qualities around the base.
    A dispute that neither explains has a half.
    """
    gaps = call_gaps(disputes, ["dispute"], error)
    if quality is not None:
        gaps = gaps.unionByName(quality_gaps(disputes, quality)).groupBy("dispute").agg(F.sum("gap").alias("gap"))
    return gaps.select("dispute", chance(F.col("gap")).alias("right"))


def expected(certain: DataFrame, disputes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Rows of the error head with the counts to expect, each dispute split by its weight of mate 1 (half without weights)."""
    both = disputes.withColumn("right", F.lit(0.5)) if weights is None else disputes.join(weights, "dispute")
    each = both.select("n", "right", F.posexplode("rows").alias("i", "r"))
    split = each.select("r.*", (F.col("n") * F.when(F.col("i") < 2, F.col("right")).otherwise(1 - F.col("right"))).alias("n"))
    whole = certain.withColumn("n", F.col("n").cast("double")).unionByName(split)
    return counted(whole, [c for c in whole.columns if c != "n"], "n")


def _only(name: str, fields: list[str]) -> Column:
    """An array of rows with these of their fields."""
    return F.transform(name, lambda r: F.struct(*(r[f].alias(f) for f in fields)))


@dataclass
class Fit:
    """weights: (dispute, right) of the table of disputes, written both. turns: fits of the error head; moved: how far the
    last one moved a weight. row, quality_row: one of
    the rows that each head was fitted to."""

    error: Head
    quality: Head
    disputes: DataFrame
    weights: DataFrame
    turns: int
    moved: float
    row: pd.DataFrame
    quality_row: pd.DataFrame

    def spec(self, **provenance: Any) -> ModelSpec:
        error, quality = self.error.components(self.row), self.quality.components(self.quality_row)
        return ModelSpec(self.error.alphabet, "pe-overlap", quality, error, provenance={"identified": ["substitution"], "turns": self.turns, "moved": self.moved, **provenance})


class _Sets:
    """The error head's fits where the sets of calls, `rows` of each `set`, and the certain rows are few enough for one machine."""

    def __init__(self, certain: DataFrame, sets: DataFrame, error: Head, penalty: Penalty) -> None:
        fields = error.fields()
        sure = certain.select(*fields, "op", "n").toArrow().to_pandas()
        calls = sets.select("set", F.posexplode("rows").alias("i", "r")).select("set", "i", "r.*").toArrow().to_pandas().sort_values(["set", "i"])
        rows = pd.concat([sure[fields], calls[fields]], ignore_index=True)
        group = rows.groupby(fields, sort=False, dropna=False).ngroup()
        self.rows, self.error, self.penalty = rows[~group.duplicated().to_numpy()].reset_index(drop=True), error, penalty
        at = group.to_numpy()
        self.ids = calls["set"].to_numpy()[::4]
        self.at, self.kind = at[len(sure) :].reshape(-1, 4), error._categories(calls["op"]).reshape(-1, 4)
        self.sure = np.zeros((len(self.rows), error.width))
        np.add.at(self.sure, (at[: len(sure)], error._categories(sure["op"])), sure["n"].to_numpy(float))

    def fit(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Fits the head to the certain rows and to disputes added up by set and by which mate is right; the sets' `call_gaps` that follow."""
        counts = self.sure.copy()
        np.add.at(counts, (self.at, self.kind), np.stack((one, one, two, two), axis=1))
        self.error.fit(self.rows, counts, self.penalty)
        x = np.maximum(self.error.log_probabilities(self.rows)[self.at, self.kind], _OFF)
        return x[:, 0] + x[:, 1] - x[:, 2] - x[:, 3]


def _chances(gap: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def _right(state: DataFrame, ids: np.ndarray, gap: np.ndarray) -> DataFrame:
    """(dispute, right), given the gap of each set's calls."""
    sent = state.sparkSession.sparkContext.broadcast((ids, gap))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, gaps = sent.value
            right = _chances(gaps[np.searchsorted(known, batch["set"].to_numpy())] + batch["around"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["dispute"], pa.array(right)], names=["dispute", "right"])

    return state.select("dispute", "set", "around").mapInArrow(run, "dispute long, right double")


def _added(state: DataFrame, ids: np.ndarray, gap: np.ndarray | None, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each set the disputes in which mate 1 is right and those in which it isn't, and how far a weight moved since the last
    gaps; without gaps a weight is a half. One pass over the disputes."""
    sent = state.sparkSession.sparkContext.broadcast((ids, gap, last))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *both = sent.value
        sums, moved = np.zeros((2, len(known))), 0.0
        for batch in batches:
            at, around = np.searchsorted(known, batch["set"].to_numpy()), batch["around"].to_numpy()
            right, before = (np.full(len(at), 0.5) if g is None else _chances(g[at] + around) for g in both)
            n = batch["n"].to_numpy()
            sums += [np.bincount(at, n * w, len(known)) for w in (right, 1 - right)]
            moved = max(moved, float(np.abs(right - before).max(initial=0.0)))
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in sums), pa.array(np.full(len(some), moved))], names=["at", "one", "two", "moved"])

    parts = state.select("set", "n", "around").mapInArrow(run, "at long, one double, two double, moved double")
    table = parts.groupBy("at").agg(F.sum("one").alias("one"), F.sum("two").alias("two"), F.max("moved").alias("moved")).toArrow().to_pandas()
    sent.unpersist()
    one, two = np.zeros(len(ids)), np.zeros(len(ids))
    one[table["at"]], two[table["at"]] = table["one"], table["two"]
    return one, two, float(table["moved"].max()) if len(table) else 0.0


def _by_set(stages: Stages, certain: DataFrame, sets: DataFrame, state: DataFrame, error: Head, penalty: Penalty, iterations: int, tolerance: float) -> tuple[DataFrame, int, float]:
    """(weights, turns, moved) of a fit whose sets go to one machine; the disputes stay in Spark."""
    own = _Sets(certain, sets, error, penalty)
    one, two, _ = _added(state, own.ids, None, None)
    gap = None
    for turn in range(1, iterations + 1):
        last, gap = gap, own.fit(one, two)
        one, two, moved = _added(state, own.ids, gap, last)
        if moved < tolerance:
            break
    return stages.write(_right(state, own.ids, gap), "weights"), turn, moved


def _by_dispute(stages: Stages, certain: DataFrame, sets: DataFrame, state: DataFrame, error: Head, penalty: Penalty, iterations: int, tolerance: float) -> tuple[DataFrame, int, float]:
    """The same with all in Spark, for any number of sets."""
    state = state.withColumn("right", F.lit(0.5))
    written: DataFrame | None = None
    for turn in range(1, iterations + 1):
        sums = state.groupBy("set").agg(F.sum(F.col("n") * F.col("right")).alias("one"), F.sum(F.col("n") * (1 - F.col("right"))).alias("two"))
        each = sets.join(sums, "set").select("one", "two", F.posexplode("rows").alias("i", "r"))
        split = each.select("r.*", F.when(F.col("i") < 2, F.col("one")).otherwise(F.col("two")).alias("n"))
        spread.fit(certain.unionByName(split), error, penalty)
        found = state.drop("last").withColumnRenamed("right", "last").join(call_gaps(sets, ["set"], error), "set")
        after = stages.write(found.withColumn("right", chance(F.col("gap") + F.col("around"))).drop("gap"), f"turn{turn}")
        moved = after.agg(F.max(F.abs(F.col("right") - F.col("last")))).first()[0] or 0.0
        if written is not None:
            stages.drop(written)
        state = written = after
        if moved < tolerance:
            break
    return state.select("dispute", "right"), turn, float(moved)


def fit(pairs: DataFrame, error_tokens: Sequence[str], quality_tokens: Sequence[str], m: int = 1, flank: tuple[int, int] = (2, 2), penalty: Penalty = Penalty(1.0, 0.01, 30.0), iterations: int = 30, tolerance: float = 1e-3, most: int = MAX_ROWS) -> Fit:
    """pairs: as `overlap.placements` gives them, of every status. The quality head is fitted once, to all bases of all pairs.

    Disputes start as a coin flip; turns end when no weight moves by the tolerance, or after so many. No overlap at all raises. Insertions and
    deletions end with no chance. Up to `most` rows of sets and certain bases are gathered; with more, turns stay in Spark and end at the same weights.
    """
    stages = Stages(pairs.sparkSession, "overlap-em")
    fields = {kind: Head(kind, list(tokens), (), flank, 1).fields() for kind, tokens in (("E", error_tokens), ("Q", quality_tokens))}
    # Only what the heads read is counted, so that equal rows are few; a read's length is the largest position of its bases.
    around = list(dict.fromkeys([*fields["Q"], "q"]))
    reads = overlap.mates(pairs).withColumn("size", F.length("seq"))
    bases = stages.write(base_counts(reads, [*around, "size"], flank), "bases")
    seen = bases.groupBy("q").agg(F.max("size").alias("top")).collect()  # one row a quality
    alphabet, top = tuple(sorted(r["q"] for r in seen if r["q"] is not None)), max((r["top"] for r in seen), default=1)
    quality, error = Head("Q", list(quality_tokens), alphabet, flank, top), Head("E", list(error_tokens), alphabet, flank, top)
    placed = pairs.filter("status = 'placed'")
    certain = stages.write(overlap.certain_counts(placed, fields["E"], flank), "certain")
    read = {"rows": [*fields["E"], "op"], **dict.fromkeys(("first", "second"), around)}
    found = overlap.evidence(placed, m, flank, apart=True).select("agree", *(_only(name, own).alias(name) for name, own in read.items()))
    open_ = stages.write(overlap.disputes(found).withColumn("dispute", F.monotonically_increasing_id()), "disputes")
    if certain.isEmpty() and open_.isEmpty():
        raise ValueError("no pair overlaps, so there is nothing to learn from")
    spread.fit(bases, quality)
    # Qualities are weighed once. Disputes of the same calls differ in them alone, so a turn scores each set of calls once.
    calls = ["c1", "c2"]
    keyed = open_.withColumns({c: F.xxhash64(F.lit(k), "rows") for k, c in enumerate(calls)})
    sets = stages.write(keyed.groupBy(*calls).agg(F.first("rows").alias("rows")).withColumn("set", F.monotonically_increasing_id()), "sets")
    weighed = keyed.join(quality_gaps(open_, quality).withColumnRenamed("gap", "around"), "dispute").join(sets.drop("rows"), calls)
    state = stages.write(weighed.select("dispute", "set", "n", "around"), "state")
    few = certain.limit(most + 1).count() + 4 * sets.limit(most + 1).count() <= most
    weights, turns, moved = (_by_set if few else _by_dispute)(stages, certain.withColumn("n", F.col("n").cast("double")), sets, state, error, penalty, iterations, tolerance)
    error.theta[0, _UNSEEN] = -np.inf
    one = lambda df, head: df.select(*head.fields()).limit(1).toArrow().to_pandas()
    shown = certain.drop("n").unionByName(open_.select(F.explode("rows").alias("r")).select("r.*"))
    return Fit(error, quality, open_, weights, turns, moved, one(shown, error), one(bases, quality))
