"""Nearest neighbours by inner product, from balanced posting lists.

Every vector lies in the list of its nearest centroid, and near a boundary in those of a few more. A graph over the
centroids is searched in memory; a query reads the lists whose centroids are not much farther than its nearest one. How
much farther is fitted: a bounded set of queries is first compared with all vectors.

Largest inner products are smallest distances once every vector has one component more, which fills its length up to that
of the longest vector (0 for queries, whose length is set to 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from ..session import Stages

#: A list of so many groups is broadcast, 24 bytes each.
BROADCAST_ROWS = 100_000
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Params:
    """list_rows: vectors that a list is meant to have; max_lists bounds the centroids, so beyond list_rows * max_lists vectors lists grow.
    sample_bytes: of the vectors that centroids are fitted on, at most `per_list` for each list.
    boundary: a vector is also put into lists whose centroids are at most so many times as far as its nearest, `copies` lists in all;
    to find them, centroids at most `wide` times as far as the best so far are expanded, for queries `flood` times the reach. degree: a centroid's links to near ones.
    region_lists: lists that stand together; a region's vectors go into blocks of block_rows and meet query_rows queries at once.
    lane_rows: a region of more vectors is dealt out.
    trial, target: queries that the reach is fitted on, and the share of their neighbours that it must find.
    """

    list_rows: int = 128
    max_lists: int = 16384
    per_list: int = 32
    sample_bytes: int = 32 << 20
    boundary: float = 1.01
    copies: int = 4
    wide: float = 1.03
    flood: float = 1.1
    degree: int = 16
    region_lists: int = 64
    lane_rows: int = 16384
    block_rows: int = 16384
    query_rows: int = 256
    trial: int = 256
    target: float = 0.95


# Centroids, on the driver


def _split(x: np.ndarray, parts: int, rng: np.random.Generator, turns: int = 8) -> np.ndarray:
    """Which of so many parts each row belongs to: k-means whose full clusters grow dearer in every turn."""
    centres, dear = x[rng.choice(len(x), parts, replace=False)].copy(), np.zeros(parts, np.float32)
    for _ in range(turns):
        own = ((centres * centres).sum(1) - 2 * x @ centres.T + dear).argmin(1)
        sizes = np.bincount(own, minlength=parts)
        dear += 0.05 * (sizes * parts / len(x) - 1).astype(np.float32)
        for j in np.flatnonzero(sizes):
            centres[j] = x[own == j].mean(0)
    return own


def centroids(x: np.ndarray, lists: int, seed: int = 7, ways: int = 8) -> np.ndarray:
    """About so many centroids of the distinct rows of x, by splitting in up to `ways` parts again and again; near ones stand near each other."""
    rng, x = np.random.default_rng(seed), np.unique(x, axis=0)
    found, todo = [], [(np.arange(len(x)), lists)]
    while todo:
        rows, wanted = todo.pop()
        own = _split(x[rows], min(ways, wanted, len(rows)), rng) if wanted > 1 and len(rows) > 1 else np.zeros(len(rows), int)
        sizes = np.bincount(own)
        if (sizes > 0).sum() < 2:
            found.append(x[rows].mean(0))
            continue
        for j in np.flatnonzero(sizes)[::-1]:
            todo.append((rows[own == j], max(1, round(wanted * sizes[j] / len(rows))) if wanted > ways else 1))
    return np.array(found, np.float32)


class Graph:
    """Centroids, each linked with its nearest ones and with those that stand beside it, so that all hang together."""

    def __init__(self, points: np.ndarray, degree: int) -> None:
        n = len(points)
        self.points, self.squares = points, (points * points).sum(1)
        near = min(degree, n)
        self.links = np.empty((n, near + 2), np.int32)
        for at in range(0, n, 1024):
            d = self.squares - 2 * points[at : at + 1024] @ points.T
            self.links[at : at + 1024, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
        self.links[:, near], self.links[:, near + 1] = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
        self.entries = np.arange(0, n, -(-n // 64))

    def search(self, x: np.ndarray, reach: float, least: float = 0.0, wide: float = 1.0, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, centroid, distance) of the centroids found within reach times the row's nearest distance, or times `least` where that is more.

        From the entries on, whatever lies within reach of the best so far (or `wide` times it) is expanded, all rows of a chunk at once.
        """
        wide = max(reach, wide)
        for start in range(0, len(x), chunk):
            own = x[start : start + chunk]
            n, square = len(own), (own * own).sum(1)
            seen = np.zeros((n, len(self.points)), bool)
            seen[:, self.entries] = True
            d = np.sqrt(np.maximum(square[:, None] + self.squares[self.entries] - 2 * own @ self.points[self.entries].T, 0))
            best = d.min(1)
            rows, nodes, d = np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n), d.ravel()
            found = [(rows, nodes, d)]
            while len(rows):
                open_ = d <= wide * np.maximum(best[rows], least)
                width = self.links.shape[1]
                key = np.repeat(rows[open_], width) * len(self.points) + self.links[nodes[open_]].ravel()
                key = np.unique(key[~seen.ravel()[key]])
                seen.ravel()[key] = True
                rows, nodes = np.divmod(key, len(self.points))
                d = np.empty(len(key), np.float32)
                for at in range(0, len(key), 100_000):
                    r, c = rows[at : at + 100_000], nodes[at : at + 100_000]
                    d[at : at + 100_000] = np.sqrt(np.maximum(square[r] + self.squares[c] - 2 * np.einsum("ij,ij->i", own[r], self.points[c]), 0))
                np.minimum.at(best, rows, d)
                found.append((rows, nodes, d))
            rows, nodes, d = (np.concatenate(part) for part in zip(*found))
            kept = d <= reach * np.maximum(best[rows], least) * (1 + 1e-6)
            yield rows[kept] + start, nodes[kept], d[kept]


@dataclass(frozen=True)
class Reading:
    """Which lists a query reads: those within reach of its nearest, and farther ones while all together have fewer than `enough` rows."""

    graph: Graph
    sizes: np.ndarray
    reach: float
    least: float
    flood: float
    enough: int

    def lists(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, list) of all rows of x, in parts; every row is whole in one of them."""
        open_, reach, wanted = np.arange(len(x)), self.reach, min(self.enough, self.sizes.sum())
        while len(open_):
            short = []
            for rows, nodes, _ in self.graph.search(x[open_], reach, self.least, self.flood * reach):
                full = np.bincount(rows, self.sizes[nodes], len(open_)) >= wanted
                yield open_[rows[full[rows]]], nodes[full[rows]]
                own = np.unique(rows)
                short.append(own[~full[own]])
            open_, reach = open_[np.concatenate(short)], reach * 1.5


# Columns and batches


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten(), np.float64).reshape(-1, dim)


def _filled(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest one's length, with the component that makes all lengths 1."""
    own = x / longest
    return np.concatenate((own, np.sqrt(np.maximum(1 - (own * own).sum(1), 0))[:, None]), axis=1).astype(np.float32)


def _asked(q: np.ndarray) -> np.ndarray:
    own = q / np.abs(q).max(1, keepdims=True)
    own /= np.sqrt((own * own).sum(1, keepdims=True))
    return np.concatenate((own, np.zeros((len(own), 1))), axis=1).astype(np.float32)


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row, components added in order, so that equal vectors have equal products wherever they stand."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        total += q[:, i] * v[:, i]
    return total


def _best(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, product) of every query's k best vectors among those allowed, never of its own id; ties to the smaller id."""
    rough = q @ v.T
    size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1).max())
    open_ = ids[None, :] != asked[:, None]
    if allowed is not None:
        open_ &= allowed
    rough[~open_] = -np.inf
    least = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k, None] if len(v) > k else np.full((len(q), 1), -np.inf)
    rows, cols = np.nonzero(open_ & (rough >= least - 1e-12 * size))
    score = np.concatenate([exact(q[rows[at : at + 100_000]], v[cols[at : at + 100_000]]) for at in range(0, len(rows), 100_000)] or [np.zeros(0)])
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(q)))[rows]
    kept = place < k
    return rows[kept], cols[kept], score[kept]


def _packed(df: DataFrame, by: list[str], most: int, schema: str) -> DataFrame:
    """Rows, which are sorted by some whole numbers, as rows of arrays: runs of equal numbers, of at most so many rows."""
    names = [f.split()[0] for f in schema.split(", ")]
    items = names[len(by) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, size = None, 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            arrays = [pa.array([x], pa.int32()) for x in key] + [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole[c].combine_chunks()) for c in items]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in by], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(keys[a].tolist())
                while a < b:
                    if held and (own != key or size == most):
                        yield flush()
                        held, size = [], 0
                    key, take = own, min(b - a, most - size)
                    held.append(batch.slice(a, take))
                    a, size = a + take, size + take
        if held:
            yield flush()

    return df.select(*by, *items).mapInArrow(run, schema)


def vectors(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v, h1, h2): rows with an id whose vector is neither null nor empty nor zero, and all of whose components are finite numbers.

    Components stay floats if they are, and are doubles else.
    """
    v = F.col(column) if df.schema[column].dataType.elementType == FloatType() else F.col(column).cast("array<double>")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(usable)
    return own.withColumns({"h1": F.xxhash64(F.lit(1), "v"), "h2": F.xxhash64(F.lit(2), "v")})


def search(df: DataFrame, id_column: str, column: str, is_query: Column, k: int, how: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for every row that is_query says, a column of df.

    Ids are whole numbers. Rows without an id, and vectors that are null, empty, zero or not of finite numbers take no part,
    nor do vectors of another length than most have (of equally many, the smaller length). Repeated rows count once; an id on
    several vectors is several candidates and several queries, whose ranks stand under one id. Rows of a query's own id are
    not its candidates (so an id on many vectors may find fewer than k). Ties go to the smaller id. Fewer candidates than k: all. No query or no candidate: no rows.
    Further columns, whatever their names, play no part.
    """
    spark = df.sparkSession
    stages = Stages(spark, "ann")
    nothing = spark.createDataFrame([], RESULT)
    usable = vectors(df, id_column, column)
    largest = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    shape = usable.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("longest")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return nothing
    dim, longest = shape["dim"], shape["longest"] or 1.0
    usable = usable.filter(F.size("v") == dim)
    asked = vectors(df.filter(is_query), id_column, column).filter(F.size("v") == dim)
    queries = stages.write(asked.dropDuplicates(["id", "h1", "h2"]).select("id", F.col("h1").alias("h"), "v"), "queries")
    if queries.isEmpty():
        return nothing
    candidates, n = _distinct(usable, k, stages)
    graph = _fit(candidates, n, dim, longest, how)
    lists = stages.write(_listed(candidates, spark.sparkContext.broadcast(graph), dim, longest, how), "lists")
    reach, least = _reach(lists, queries, graph, dim, k, how)
    if reach is None:
        return nothing
    counted = lists.select(F.explode("lists").alias("list")).groupBy("list").count().toArrow()  # at most max_lists rows
    sizes = np.bincount(counted["list"].to_numpy(), counted["count"].to_numpy(), len(graph.points))
    lanes, blocks = _blocks(lists, stages, how)
    stages.drop(lists)
    stages.tidy()
    found = _scan(blocks, lanes, queries, spark.sparkContext.broadcast(Reading(graph, sizes, reach, least, how.flood, how.copies * (k + 1))), dim, k, how)
    rank = F.dense_rank().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k).dropDuplicates(["query_id", "h", "rank", "vec_id"])
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _distinct(usable: DataFrame, k: int, stages: Stages) -> tuple[DataFrame, int]:
    """(id, v) without repeated rows, and of copies of one vector the k + 1 of the smallest ids, as no more can be among anyone's k nearest; and how many.

    Only hashes are counted and shuffled; vectors are where there are repeated rows, or so many groups of copies that the list of them isn't broadcast.
    """
    keys = stages.write(usable.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n")), "keys")
    rows, repeats = keys.agg(F.count(F.lit(1)), F.max("n")).first()
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    last = stages.write(keys.withColumn("place", place).filter(F.col("place") == k + 1).select("h1", "h2", F.col("id").alias("last")), "last")
    groups = last.count()
    own = usable.dropDuplicates(["h1", "h2", "id"]) if repeats and repeats > 1 else usable
    if not groups:
        return own.select("id", "v"), rows
    ends = F.broadcast(last) if groups <= BROADCAST_ROWS else last
    gone = keys.join(ends, ["h1", "h2"]).filter("id > last").count()
    return own.join(ends, ["h1", "h2"], "left").filter("last is null or id <= last").select("id", "v"), rows - gone


def _fit(candidates: DataFrame, n: int, dim: int, longest: float, how: Params) -> Graph:
    """The graph of centroids, from the vectors of a share of all rows that a hash of their ids and components picks."""
    lists = min(how.max_lists, -(-n // how.list_rows))
    rows = min(how.sample_bytes // (4 * dim + 4), lists * how.per_list)
    share = min(1.0, rows / n)
    picked = candidates.filter(F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * rows)
    sample = _filled(_matrix(picked.toArrow()["v"], dim), longest)
    if not len(sample):  # a table of a few rows may have none under the hash's bound
        sample = _filled(_matrix(candidates.limit(1).select("v").toArrow()["v"], dim), longest)
    return Graph(centroids(sample, lists), how.degree)


def _listed(candidates: DataFrame, graph, dim: int, longest: float, how: Params) -> DataFrame:
    """(region, id, v, lists): every vector once in each region that has lists of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _filled(_matrix(batch["v"], dim), longest)
            for rows, nodes, d in graph.value.search(x, how.boundary, wide=how.wide):
                order = np.lexsort((nodes, d, rows))
                rows, nodes = rows[order], nodes[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, nodes = rows[place < how.copies], nodes[place < how.copies]
                yield _by_region(batch, rows, nodes, how, ["region", "id", "v", "lists"])

    return candidates.mapInArrow(run, f"region int, id long, v {candidates.schema['v'].dataType.simpleString()}, lists array<int>")


def _reach(lists: DataFrame, queries: DataFrame, graph: Graph, dim: int, k: int, how: Params) -> tuple[float | None, float]:
    """How many times the nearest centroid's distance finds the target's share of true neighbours, and the least distance that counts as nearest."""
    trial = queries.orderBy(F.xxhash64("id", "h"), "id", "h").limit(how.trial).toArrow()
    ids, q = trial["id"].to_numpy(), _matrix(trial["v"], dim)
    x = _asked(q)
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + graph.squares - 2 * x @ graph.points.T, 0))
    least = max(float(np.median(d.min(1))) / 2, 1e-6)
    ratio = d / np.maximum(d.min(1), least)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols, score = _best(ids, q, batch["id"].to_numpy(), _matrix(batch["v"], dim), None, k)
            own, offsets = np.asarray(batch["lists"].flatten()), batch["lists"].offsets.to_numpy()
            offsets = offsets - offsets[0]
            need = [float(ratio[r, own[offsets[c] : offsets[c + 1]]].min()) for r, c in zip(rows, cols)]
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), batch["id"].take(pa.array(cols)), pa.array(score), pa.array(need, pa.float64())], names=["q", "id", "score", "need"])

    near = lists.mapInArrow(run, "q int, id long, score double, need double").groupBy("q", "id", "score").agg(F.min("need").alias("need"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    needs = np.sort(near.withColumn("rank", rank).filter(F.col("rank") <= k).select("need").toArrow()["need"].to_numpy())
    return (float(needs[min(len(needs) - 1, int(np.ceil(how.target * len(needs))))]) if len(needs) else None), least


def _by_region(batch: pa.RecordBatch, rows: np.ndarray, nodes: np.ndarray, how: Params, names: list[str]) -> pa.RecordBatch:
    """A row for each row of the batch and region that it has lists in: the region, the batch's columns, the lists."""
    order = np.lexsort((nodes, rows))
    rows, nodes = rows[order], nodes[order]
    region = nodes // how.region_lists
    first = np.flatnonzero(np.concatenate(([True], (np.diff(rows) != 0) | (np.diff(region) != 0)))) if len(rows) else np.zeros(0, int)
    at = pa.array(rows[first], pa.int64())
    own = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(nodes)], pa.int32()), pa.array(nodes.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(region[first].astype(np.int32)), *(c.take(at) for c in batch.columns), own], names=names)


def _blocks(lists: DataFrame, stages: Stages, how: Params) -> tuple[DataFrame, DataFrame]:
    """(region, lanes), and the vectors of each region and lane as rows of arrays. Large regions are dealt out to lanes by id."""
    sizes = lists.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / how.lane_rows).cast("int").alias("lanes")).collect()  # max_lists bounds the number of regions
    lanes = lists.sparkSession.createDataFrame(sizes, "region int, lanes int")
    lane = F.pmod(F.xxhash64("id"), F.col("lanes")).cast("int")
    dealt = lists.join(F.broadcast(lanes), "region").withColumn("lane", lane).repartition("region", "lane").sortWithinPartitions("region", "lane")
    kind = lists.schema["v"].dataType.simpleString()
    schema = f"region int, lane int, ids array<long>, vs array<{kind}>, lists array<array<int>>"
    return lanes, stages.write(_packed(dealt.withColumnsRenamed({"id": "ids", "v": "vs"}), ["region", "lane"], how.block_rows, schema), "blocks")


def _scan(blocks: DataFrame, lanes: DataFrame, queries: DataFrame, reading, dim: int, k: int, how: Params) -> DataFrame:
    """(query_id, h, vec_id, score) of each query's k best vectors in every block of a region that it reads lists of.

    A region's queries, in chunks, are sent to each of its lanes.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, nodes in reading.value.lists(_asked(_matrix(batch["v"], dim))):
                yield _by_region(batch, rows, nodes, how, ["region", "query_ids", "hs", "qs", "asked"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                column = lambda name: batch[name].slice(i, 1).flatten()
                base = batch["region"][i].as_py() * how.region_lists
                ids, asked = column("ids").to_numpy(), column("query_ids").to_numpy()
                vs, own, qs, wanted = column("vs"), column("lists"), column("qs"), column("asked")
                allowed = np.zeros((len(asked), how.region_lists), bool)
                allowed[np.repeat(np.arange(len(asked)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy() - base] = True
                counts, flat = own.value_lengths().to_numpy(), own.flatten().to_numpy() - base
                starts = np.cumsum(counts) - counts
                open_ = np.zeros((len(asked), len(ids)), bool)
                for slot in range(counts.max()):
                    has = np.flatnonzero(counts > slot)
                    open_[:, has] |= allowed[:, flat[starts[has] + slot]]
                rows, cols, score = _best(asked, _matrix(qs, dim), ids, _matrix(vs, dim), open_, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[rows]), column("hs").take(pa.array(rows)), pa.array(ids[cols]), pa.array(score)], names=["query_id", "h", "vec_id", "score"]
                )

    kind = queries.schema["v"].dataType.simpleString()
    routed = queries.select("id", "h", "v").mapInArrow(route, f"region int, query_ids long, hs long, qs {kind}, asked array<int>")
    # A region may have most queries, so that they are dealt out evenly and packed where they lie.
    spread = routed.withColumn("deal", F.pmod(F.xxhash64("query_ids", "hs"), F.lit(64))).repartition("region", "deal").sortWithinPartitions("region")
    chunks = _packed(spread, ["region"], how.query_rows, f"region int, query_ids array<long>, hs array<long>, qs array<{kind}>, asked array<array<int>>")
    sent = chunks.join(F.broadcast(lanes), "region").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")
    return sent.join(blocks, ["region", "lane"]).mapInArrow(scan, "query_id long, h long, vec_id long, score double")
