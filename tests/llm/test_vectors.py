"""Nearest neighbours and clusters of vectors against brute force, ties, copies and edge cases."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from readlens.llm import ann, exponion, queries

SMALL = ann.Params(list_rows=40, region_lists=4, block_rows=300, query_rows=16, lane_rows=500, trial=40)


def table(spark, x, ids=None):
    return spark.createDataFrame([(i, v) for i, v in zip(ids or range(len(x)), [r.tolist() for r in x])], "vec_id long, embedding array<double>")


def brute(ids, x, k, step=20):
    out = {}
    for i in np.flatnonzero(np.array(ids) % step == 0):
        score = ann.exact(np.repeat(x[i : i + 1], len(x), 0), x)
        near = sorted((-s, j) for j, s in zip(ids, score.tolist()) if j != ids[i])[:k]
        out[ids[i]] = [(j, -s) for s, j in near]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(own, truth):
    return np.mean([len({j for j, _ in truth[q]} & {j for j, _ in own.get(q, [])}) / len(truth[q]) for q in truth])


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths", "tight"])
def test_recall_and_exact_scores(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] * 3 + 0.3 * x
    if kind == "tight":  # most queries lie on a centroid whose lists have fewer rows than are wanted
        x[:1500] = rng.normal(size=(300, 24))[np.arange(1500) // 5] + 1e-3 * x[:1500]
    if kind == "lengths":  # the largest product isn't the smallest distance here
        x *= rng.lognormal(sigma=1, size=(3000, 1))
    own, truth = found(ann.search(table(spark, x), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10, SMALL)), brute(list(range(3000)), x, 10)
    assert own.keys() == truth.keys() and recall(own, truth) >= 0.9 and all(len(near) == 10 for near in own.values())
    for q, near in own.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        assert all(s == ann.exact(x[q : q + 1], x[j : j + 1])[0] for j, s in near)


def test_a_third_are_copies(spark):
    """Copies beyond k + 1 aren't searched, and ties among them go to the smallest ids."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 16))
    x[::3] = x[0]
    own = found(ann.search(table(spark, x), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5, SMALL))
    assert [j for j, _ in own[600]] == [0, 3, 6, 9, 12] and [j for j, _ in own[0]] == [3, 6, 9, 12, 15]
    assert recall(own, brute(list(range(1200)), x, 5)) >= 0.9
    few = ann._distinct(ann.vectors(table(spark, x), "vec_id", "embedding"), 5, ann.Stages(spark, "t"))
    assert few[1] == few[0].count() == 806


def test_search_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (1, [1.0, 0.0], None), (2, [0.5, 0.5], "c"), (3, None, "d"), (4, [0.0, 0.0], "e"), (5, [1.0, None], "f"), (6, [nan, 1.0], "g"),
            (7, [inf, 1.0], "h"), (20, [], "i"), (40, [1.0, 2.0, 3.0], "j"), (None, [3.0, 3.0], "k"), (60, [-1.0, 0.0], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, region string").withColumns({"lane": F.lit(1), "v": F.lit(2), "H1": F.lit(3)})
    own = found(ann.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20))
    assert own == {0: [(1, 1.0), (2, 0.5), (60, -1.0)], 60: [(2, -0.5), (0, -1.0), (1, -1.0)]}
    assert ann.search(df.filter("false"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 0
    assert ann.search(df.filter("vec_id = 1"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 0
    assert ann.search(df.filter("vec_id = 60"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 0
    floats = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert found(ann.search(floats, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)) == own


def test_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(7)
    points = ann.centroids(rng.normal(size=(4000, 12)).astype(np.float32), 300)
    graph, x = ann.Graph(points, 16), rng.normal(size=(500, 12)).astype(np.float32)
    d = np.sqrt(((x[:, None] - points[None]) ** 2).sum(2))
    near = d <= 1.2 * d.min(1, keepdims=True)
    got = np.zeros_like(near)
    for rows, nodes, _ in graph.search(x, 1.2, wide=1.2 * 1.1):
        got[rows, nodes] = True
    assert (got & near).sum() >= 0.98 * near.sum() and not (got & ~(d <= 1.21 * d.min(1, keepdims=True))).sum(1).max() > 20
    sizes = np.bincount(((x[:, None] - points[None]) ** 2).sum(2).argmin(1), minlength=len(points))
    assert 200 <= len(points) <= 400 and sizes.max() < 30


def lloyd(rows, k, rounds, dim):
    rows = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if i is not None and v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    points = [list(v) for _, v in start]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points)) for _, v in rows]
        if turn < rounds:
            for c in range(len(points)):
                if own := [v for (_, v), (_, j) in zip(rows, near) if j == c]:
                    points[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i, c, d, sum(e for e, j in near if j == c), sum(e for e, _ in near), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(rows, near))


@pytest.mark.parametrize("step", [None, 1 / 1024])
def test_clusters_equal_plain_rounds(spark, step):
    """With a coarse grid of values, many vectors are equally far from several centroids."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 4)) if step is None else rng.integers(-2, 3, size=(600, 4)) * step
    x[::3] = x[0]
    df = table(spark, x)
    for k, rounds in ((1, 3), (8, 10), (40, 6)):
        assert sorted(map(tuple, exponion.cluster(df, "vec_id", "embedding", k, rounds, 4).collect())) == lloyd(list(enumerate(x.tolist())), k, rounds, 4)


def test_bounds_spare_distances():
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(50, 8))[rng.integers(0, 50, 4000)] * 4000 + rng.normal(size=(4000, 8)) * 200).astype(np.int64)
    points = x[:50].copy()
    own, upper, lower, _ = exponion.assign(x, np.zeros(4000, int), np.full(4000, np.inf), np.zeros(4000), exponion.Centres(points, None))
    for _ in range(4):
        before, points = points, np.array([x[own == c].sum(0) // max((own == c).sum(), 1) if (own == c).any() else points[c] for c in range(50)])
        own, upper, lower, looked = exponion.assign(x, own, upper, lower, exponion.Centres(points, before))
        d = ((x[:, None] - points[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1))).all()
        assert (lower <= np.sqrt(np.partition(d, 1, axis=1)[:, 1])).all()
    assert looked < 4000 * 50 / 10


def test_cluster_edge_cases(spark):
    rows = [(1, [0.5, 1.0], "a"), (1, [0.5, 1.0], "a"), (1, [0.25, 1.0], None), (2, None, "b"), (3, [1.0], "c"), (4, [float("nan"), 1.0], "d"), (5, [None, 1.0], "e"), (None, [1.0, 1.0], "f"), (6, [-0.3, 0.7], "g"), (7, [], "h")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").withColumn("ids", F.lit(1))
    assert sorted(map(tuple, exponion.cluster(df, "vec_id", "embedding", dim=2).collect())) == lloyd([r[:2] for r in rows], 8, 10, 2)
    assert exponion.cluster(df.filter("false"), "vec_id", "embedding", dim=2).count() == 0
    with pytest.raises(Exception, match="not below"):
        exponion.cluster(spark.createDataFrame([(1, [1e9, 1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", dim=2).count()


def test_cluster_sql(spark, tmp_path):
    rng = np.random.default_rng(10)
    table(spark, rng.normal(size=(300, 64))).write.parquet(f"{tmp_path}/embeddings.parquet")
    own = sorted(map(tuple, queries.op12_clusters(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(queries.ORACLE_SQL["op12_clusters"]).fetchall()) == own
