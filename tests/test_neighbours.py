"""Neighbours and layouts of embeddings against all pairs, and the plane against eigenvectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import coverage, neighbours
from framesift.queries.images import coverage_plane, embedding_neighbours

DATA = "/root/testdata/sf0.001"


def all_pairs(vectors: np.ndarray, k: int) -> list[set[int]]:
    d = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return [set(np.argsort(row, kind="stable")[:k].tolist()) for row in d]


def test_recall_of_neighbours(spark):
    """Of the given embeddings, all of them: at least nine in ten of the true ten nearest are found."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    truth = all_pairs(np.array([r.embedding for r in rows], float), 10)
    ids = [r.vec_id for r in rows]
    found: dict[int, set[int]] = {}
    distances = {}
    for r in embedding_neighbours(spark, DATA).collect():
        found.setdefault(ids.index(r.vec_id), set()).add(ids.index(r.near_id))
        distances[r.vec_id, r.near_id] = r.distance
    assert all(len(v) == 10 for v in found.values()) and len(found) == len(rows)
    assert sum(len(found[i] & truth[i]) for i in range(len(rows))) >= 0.9 * 10 * len(rows)
    (a, b), d = next(iter(distances.items()))
    assert d == pytest.approx(np.linalg.norm(np.array(rows[ids.index(a)].embedding, float) - np.array(rows[ids.index(b)].embedding, float)), abs=1e-6)


def test_neighbours_are_exact(spark, monkeypatch):
    """Points without groups, of which rounds of neighbours of neighbours lose many, and copies; over several tasks, blocks and tiles."""
    for name, value in (("PARTS", 3), ("BLOCK", 150), ("TILE", 64), ("MEASURED", 100)):
        monkeypatch.setattr(neighbours, name, value)
    points = np.random.default_rng(5).normal(0, 1, (1300, 64))
    points[::9] = points[0]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    found = neighbours.neighbour_graph(spark.createDataFrame(rows, "ord long, vector array<double>").repartition(5), 10).toPandas()
    assert len(found) == 13000 and found.groupby("u").v.nunique().eq(10).all() and (found.u != found.v).all()
    found = found.sort_values(["u", "d", "v"])
    for i in range(0, 1300, 7):
        d = np.round(np.sqrt(((points - points[i]) ** 2).sum(axis=1)), 9)
        d[i] = np.inf
        want = np.lexsort((np.arange(1300), d))[:10]
        mine = found[found.u == i]
        assert mine.v.tolist() == want.tolist() and np.allclose(mine.d, d[want], atol=2e-9, rtol=0)


def test_small_and_equal_inputs(spark):
    vectors = lambda rows: spark.createDataFrame(rows, "ord long, vector array<double>")
    assert neighbours.neighbour_graph(vectors([])).count() == 0 and neighbours.neighbour_graph(vectors([(0, [1.0])])).count() == 0
    few = neighbours.neighbour_graph(vectors([(i, [float(i * i)]) for i in range(5)]), 15).collect()
    assert sorted((r.u, r.v, r.d) for r in few) == [(i, j, abs(float(i * i - j * j))) for i in range(5) for j in range(5) if i != j]
    same = neighbours.neighbour_graph(vectors([(i, [1.0, 2.0]) for i in range(40)]), 3)
    assert same.count() == 120 and same.filter("d <> 0 OR u = v").count() == 0
    schema = "path string, embedding array<float>"
    assert neighbours.coverage_layout(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.coverage_layout(spark.createDataFrame([("a", [1.0]), ("b", None)], schema)).collect() == [("a", 0.0, 0.0)]


def test_layout_keeps_neighbours_together(spark, monkeypatch):
    """Four groups, one of them copies: reruns agree, and places of one group are nearer than those of others."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (4, 12))
    rows = [(f"p{i:03}", [float(x) for x in centres[i % 4] + (0 if i % 4 == 3 else 1) * rng.normal(0, 1, 12)], "x") for i in range(48)]
    df = spark.createDataFrame(rows, "path string, embedding array<float>, ord string")
    first = {r.path: (r.x, r.y) for r in neighbours.coverage_layout(df, epochs=8).collect()}
    again = {r.path: (r.x, r.y) for r in neighbours.coverage_layout(df.repartition(3), epochs=8).collect()}
    assert first == again and len(first) == 48
    at = np.array([first[f"p{i:03}"] for i in range(48)])
    near = all_pairs(at + rng.normal(0, 1e-9, at.shape), 5)
    assert sum(j % 4 == i % 4 for i in range(48) for j in near[i]) >= 0.95 * 5 * 48
    assert neighbours.plane_of(df.limit(20))[0] == "pca"
    monkeypatch.setattr(neighbours, "coverage_layout", lambda rows, key, embedding: rows)
    assert neighbours.plane_of(df)[0] == "layout"


def test_weights_are_worth_the_logarithm(spark):
    rng = np.random.default_rng(9)
    graph = neighbours.neighbour_graph(spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 5)]) for i in range(60)], "ord long, vector array<double>"), 8)
    weights = neighbours._weights(graph).collect()
    assert all(0 <= r.w <= 1 and r.u < r.v for r in weights) and len({(r.u, r.v) for r in weights}) == len(weights)
    nearest = {r.u: r.v for r in graph.groupBy("u").agg(F.min_by("v", "d").alias("v")).collect()}
    sure = {(r.u, r.v) for r in weights if r.w == pytest.approx(1)}
    assert all((min(u, v), max(u, v)) in sure for u, v in nearest.items())


def test_plane_by_eigenvectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], float)
    centred = m - m.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov(centred.T))
    want = centred @ vectors[:, [-1, -2]]
    got = {r.vec_id: r for r in coverage_plane(spark, DATA).collect()}
    at = np.array([[got[r.vec_id].x, got[r.vec_id].y] for r in rows])
    for k in range(2):
        sign = np.sign((at[:, k] * want[:, k]).sum())
        assert np.allclose(at[:, k], sign * want[:, k], atol=1e-6)
    pct = np.array([[got[r.vec_id].x_pct, got[r.vec_id].y_pct] for r in rows])
    span = (at - at.min(axis=0)) / (at.max(axis=0) - at.min(axis=0)) * 100
    assert np.allclose(pct[:, 0], span[:, 0]) and np.allclose(pct[:, 1], 100 - span[:, 1])
    assert coverage.principal_plane(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 2.0])], "path string, embedding array<double>")).count() == 2
