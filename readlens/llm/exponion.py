"""Exact k-means over whole-number vectors, with bounds that spare most distances (exponion search).

Every vector keeps an upper bound of the distance to its centroid and a lower bound of that to any other. Where the bounds
leave doubt, only centroids in a ball around the vector's own centroid are looked at: those at most twice the vector's
distance plus the distance to that centroid's nearest neighbour away. Each centroid has the others sorted by distance, so
the ball is a prefix of that list. The ball includes its rim and bounds must be strictly apart, so ties are seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Components are below this in size, so that squared distances of up to 128 of them are exact 64-bit integers.
LARGEST = 1 << 27
#: Bounds give way by this share, more than their floating-point error.
SLACK = 1e-9


class Centres:
    """Whole-number centroids, for each the others by distance, and how far each has moved."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None) -> None:
        self.points = points
        n = len(points)
        gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2).astype(float))
        gap[np.arange(n), np.arange(n)] = -1  # each stands first in its own list, before copies of it
        self.order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gap, self.order, 1)
        self.nearest = self.gaps[:, 0] if n > 1 else np.full(n, np.inf)
        moved = np.zeros(n) if before is None else np.sqrt(((points - before) ** 2).sum(1).astype(float))
        self.moved = moved
        most = moved.argmax()
        self.others_moved = np.where(np.arange(n) == most, np.delete(moved, most).max(initial=0.0), moved[most])


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - point
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(centroid, upper, lower) of each vector after the centroids have moved, and how many distances that took.

    The centroid is the nearest, of equally near ones that of the smaller number.
    """
    before, own, looked = own, own.copy(), 0
    upper = (upper + centres.moved[own]) * (1 + SLACK)
    lower = (lower - centres.others_moved[own]) * (1 - SLACK)
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        enough = np.maximum(lower[rows], centres.nearest[c] / 2 * (1 - SLACK))
        rows, enough = rows[upper[rows] >= enough], enough[upper[rows] >= enough]
        best = squared(x[rows], centres.points[c])
        upper[rows] = np.sqrt(best) * (1 + SLACK)
        doubt = upper[rows] >= enough
        looked += len(rows)
        rows, best = rows[doubt], best[doubt]
        if not len(rows) or len(centres.points) == 1:
            continue
        within = np.searchsorted(centres.gaps[c], (2 * upper[rows] + centres.nearest[c]) * (1 + SLACK), side="right")
        number, second = np.full(len(rows), c), np.full(len(rows), np.iinfo(np.int64).max)
        for place in range(within.max()):
            open_ = np.flatnonzero(within > place)
            j = centres.order[c, place]
            d = squared(x[rows[open_]], centres.points[j])
            looked += len(open_)
            wins = (d < best[open_]) | ((d == best[open_]) & (j < number[open_]))
            second[open_] = np.where(wins, best[open_], np.minimum(second[open_], d))
            best[open_], number[open_] = np.where(wins, d, best[open_]), np.where(wins, j, number[open_])
        own[rows], upper[rows], lower[rows] = number, np.sqrt(best) * (1 + SLACK), np.sqrt(second.astype(float)) * (1 - SLACK)
    return own, upper, lower, looked


STATE = "ids array<long>, vs array<int>, own array<int>, upper array<double>, lower array<double>, cluster array<int>, total array<long>, looked long"


def _row(values: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int64()]
    arrays = [pa.array([None], pa.list_(t)) if v is None else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in zip(values, types)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([values[-1]], pa.int64())], names=[f.split()[0] for f in STATE.split(", ")])


def _turn(dim: int, k: int, centres):
    """One assignment of all vectors. Each task ends with a row that says what it added to the centroids' sizes and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, looked = np.zeros((k, dim + 1), np.int64), 0
        for batch in batches:
            for i in np.flatnonzero(batch["ids"].is_valid().to_numpy(zero_copy_only=False)).tolist():
                part = lambda name: batch[name].slice(i, 1).flatten().to_numpy()
                x, before = part("vs").reshape(-1, dim), part("own")
                known = np.maximum(before, 0)  # -1 at first, with an upper bound that leaves doubt
                own, upper, lower, n = assign(x, known, part("upper"), part("lower"), centres)
                looked += n
                for c in range(k):
                    joined, gone = x[(own == c) & (before != c)], x[(before == c) & (own != c)]
                    total[c, 0] += len(joined) - len(gone)
                    total[c, 1:] += joined.sum(0, dtype=np.int64) - gone.sum(0, dtype=np.int64)
                yield _row([part("ids"), x.ravel(), own, upper, lower, None, None, None])
        yield _row([None, None, None, None, None, np.repeat(np.arange(k), dim + 1), total.ravel(), looked])

    return run


def _blocks(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                yield _row([batch["id"].to_numpy(), batch["v"].flatten().to_numpy(), np.full(n, -1), np.full(n, np.inf), np.zeros(n), None, None, None])

    return run


def _unpacked(dim: int, centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in np.flatnonzero(batch["ids"].is_valid().to_numpy(zero_copy_only=False)).tolist():
                part = lambda name: batch[name].slice(i, 1).flatten().to_numpy()
                own, x = part("own"), part("vs").reshape(-1, dim)
                d = x.astype(np.int64) - centres.points[own]
                yield pa.RecordBatch.from_arrays([pa.array(part("ids")), pa.array(own), pa.array(np.einsum("ij,ij->i", d, d))], names=["vec_id", "cluster", "distance"])

    return run


def kept(df: DataFrame, id_column: str, column: str, dim: int, scale: int) -> DataFrame:
    """(id, v): rows with an id and a vector of so many components, none null or not finite, as floor(scale * component).

    Components whose whole number is LARGEST or more in size raise an error: distances of type long couldn't hold them.
    """
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.exists("v", lambda x: F.abs(x) >= (LARGEST - 1) / scale)
    own = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dim)).filter(finite)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    return own.select("id", F.when(large, F.raise_error(F.lit(f"a component is not below {LARGEST} / {scale}"))).otherwise(whole).alias("v"))


def cluster(df: DataFrame, id_column: str, column: str, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept, after so many rounds of k-means.

    The k vectors with the smallest sha256 of `seed:id` are the first centroids (fewer vectors: all of them). A round assigns
    all vectors, then moves every centroid that has any to the floor of its vectors' mean; after the last, vectors are assigned
    once more. A row without an id, or with a vector that is null, of another length or not of finite numbers, isn't kept.
    Repeated rows count as often as they occur; those of one id start in order of their components. No vectors: no rows.
    """
    if dim > 128:
        raise ValueError("at most 128 components")
    spark = df.sparkSession
    stages = Stages(spark, "exponion")
    rows = kept(df, id_column, column, dim, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest, "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    k, points, before = len(first), np.array([r["v"] for r in first], np.int64), None
    total = [[0] * (dim + 1) for _ in range(k)]
    state = stages.write(rows.mapInArrow(_blocks(dim), STATE), "start")
    for turn in range(rounds + 1):
        centres = Centres(points, before)
        after = stages.write(state.mapInArrow(_turn(dim, k, centres), STATE), f"turn{turn}")
        stages.drop(state)
        state = after
        if turn == rounds:
            break
        gained = after.filter("ids is null").select(F.posexplode("total").alias("place", "gain")).groupBy("place").agg(F.sum("gain").alias("gain"))
        for r in gained.collect():  # k times the components
            total[r["place"] // (dim + 1)][r["place"] % (dim + 1)] += r["gain"]
        before, points = points, np.array([[s // own[0] for s in own[1:]] if own[0] else points[c].tolist() for c, own in enumerate(total)], np.int64)
    out = state.select("ids", "vs", "own").mapInArrow(_unpacked(dim, centres), "vec_id long, cluster int, distance long")
    names = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points.tolist())], "cluster int, centroid_sha256 string")
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sums = spark.createDataFrame([(c, s, sum(inertia.values())) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long")
    return out.join(F.broadcast(sums.join(names, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
