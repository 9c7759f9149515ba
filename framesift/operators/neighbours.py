"""Nearest neighbours of embeddings by products of blocks, and a layout that keeps them together.

The graph is exact: each block of points meets each other block, as one matrix product. (Neighbours of neighbours and random
projections, which compare fewer pairs, lose most of the nearest where points have no groups: see the README.) The layout then
pulls neighbours together and pushes sampled others apart in synchronous epochs: in each, all forces are summed up from the
places of the epoch before. Sums are of whole numbers, so that reruns agree to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.operators.coverage import principal_components, principal_plane
from framesift.operators.order import counted, kept, scan_order, written

#: Neighbours of each point.
NEIGHBOURS = 15
#: Tasks that points are dealt over, points of a block and of a tile of a task's own points, and pairs that are measured at once.
PARTS, BLOCK, TILE, MEASURED = 48, 2048, 256, 100_000
#: Epochs of the layout, points that each is pushed from in one, and the curve's parameters for a spread of 1 and a least distance of 0.1.
EPOCHS, PUSHED_FROM = 20, 5
CURVE_A, CURVE_B = 1.577, 0.895
#: Forces are summed as whole multiples of this.
UNIT = 1e-9


def _merged(held: tuple[np.ndarray, np.ndarray], row: np.ndarray, d: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of what each row held, (distances, ords), and of more (row, d, v); of equal distances the smaller ord."""
    n, k = held[0].shape
    row, d, v = np.concatenate([np.repeat(np.arange(n), k), row]), np.concatenate([held[0].ravel(), d]), np.concatenate([held[1].ravel(), v])
    order = np.lexsort((v, d, row))
    row, d, v = row[order], d[order], v[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    first = place < k
    return d[first].reshape(n, k), v[first].reshape(n, k)


def _met(points: np.ndarray, held: tuple[np.ndarray, np.ndarray], at: int, others: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """held of points (ords from at), after they have met others (ords from start).

    A matrix product tells who is near; only these are measured, by differences. Others come by rising ord, so one that is
    as far as the last of a full list has no place in it.
    """
    k = held[0].shape[1]
    square, other = (points * points).sum(axis=1), (others * others).sum(axis=1)
    near = np.column_stack([points, np.full(len(points), -0.5)]) @ np.column_stack([others, other]).T
    # |x - y|^2 < r is x y - |y|^2 / 2 > (|x|^2 - r) / 2; what the product may be off by
    off = 1e-13 * (square + other.max(initial=0.0))
    least = (square - held[0][:, -1] ** 2) / 2 + off
    is_near = near > least[:, None]
    crowded = np.flatnonzero(np.count_nonzero(is_near, axis=1) > 4 * k)
    if len(crowded):
        kth = np.partition(near[crowded], -k - 1, axis=1)[:, -k - 1]
        is_near[crowded] &= near[crowded] >= (kth - 2 * off[crowded])[:, None]
    row, col = np.divmod(np.flatnonzero(is_near), len(others))
    other_than = row + at != col + start
    row, col = row[other_than], col[other_than]
    d = np.empty(len(row))
    for i in range(0, len(row), MEASURED):
        apart = points[row[i : i + MEASURED]] - others[col[i : i + MEASURED]]
        d[i : i + MEASURED] = np.round(np.sqrt((apart * apart).sum(axis=1)), 9)
    return _merged(held, row, d, col + start) if len(row) else held


def _matrix(rows: pa.ListScalar) -> np.ndarray:
    return rows.values.flatten().to_numpy().reshape(len(rows.values), -1)


def neighbour_graph(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """u, v, d: the k nearest others of each of (ord, vector), ord from 0 without gaps; all others if there are k or fewer.

    Points are dealt over PARTS tasks, and each meets all others, a block at a time, by matrix products; a task holds its own
    points, their lists and one block. So all pairs are compared, and what is shuffled is the vectors, PARTS times.
    Of equal distances the smaller ord comes first. Copies of one vector are at distance 0 from each other.
    """
    vectors = kept(vectors.select("ord", F.col("vector").cast("array<double>").alias("vector")))
    n = vectors.count()
    if n < 2:
        return vectors.select(F.col("ord").alias("u"), F.col("ord").alias("v"), F.lit(0.0).alias("d")).limit(0)
    size = max(1, min(BLOCK, -(-n // PARTS)))
    blocks = -(-n // size)
    each = -(-blocks // PARTS)
    parts = -(-blocks // each)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "vector"))), lambda x: x["vector"])
    packed = written(vectors.groupBy(F.floor(F.col("ord") / size).cast("int").alias("block")).agg(listed.alias("rows")))
    own = packed.select("block", "rows", F.floor(F.col("block") / each).cast("int").alias("part"), F.lit(0).alias("turn"))
    met = packed.select("block", "rows", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("turn"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: list[tuple[int, np.ndarray]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for block, rows, turn in zip(batch.column("block").to_pylist(), batch.column("rows"), batch.column("turn").to_pylist(), strict=True):
                matrix = _matrix(rows)
                if turn == 0:
                    for i in range(0, len(matrix), TILE):
                        tile = matrix[i : i + TILE]
                        points.append((block * size + i, tile))
                        held.append((np.full((len(tile), k), np.inf), np.full((len(tile), k), -1)))
                else:
                    held = [_met(tile, own_list, at, matrix, block * size) for (at, tile), own_list in zip(points, held, strict=True)]
        for (at, _), (d, v) in zip(points, held, strict=True):
            row, col = np.nonzero(v >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(row + at, pa.int64()), pa.array(v[row, col], pa.int64()), pa.array(d[row, col], pa.float64())], names=["u", "v", "d"])

    dealt = own.unionByName(met).repartitionById(parts, F.col("part")).sortWithinPartitions("turn", "block")
    return written(dealt.select("block", "rows", "turn").mapInArrow(nearest, "u long, v long, d double"))


def _weights(graph: DataFrame) -> DataFrame:
    """u, v, w with u < v: how surely two points are neighbours.

    A point's nearest other is sure; the others fade with the distance beyond it, on a scale that makes the list worth the logarithm of its length.
    Either side's word is enough: w = a + b - a b.
    """
    lists = graph.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("near"))
    nearest = F.coalesce(F.array_min(F.filter(F.transform("near", lambda x: x["d"]), lambda d: d > 0)), F.lit(0.0))
    lists = lists.withColumn("nearest", nearest)
    beyond = lambda x: F.greatest(F.lit(0.0), x["d"] - F.col("nearest"))
    lists = lists.withColumn("beyond", F.transform("near", beyond)).withColumn("worth", F.log2(F.size("near") + F.lit(0.0)))

    def halve(ends: Column, _: Column) -> Column:
        mid = (ends["low"] + ends["high"]) / 2
        total = F.aggregate("beyond", F.lit(0.0), lambda s, x: s + F.exp(-x / mid))
        too_much = total > F.col("worth")
        return F.struct(F.when(too_much, ends["low"]).otherwise(mid).alias("low"), F.when(too_much, mid).otherwise(ends["high"]).alias("high"))

    widest = F.array_max("beyond") * 10 + 1e-6
    scale = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(1e-9).alias("low"), widest.alias("high")), halve, lambda e: e["high"])
    each = lists.withColumn("scale", scale).select("u", "scale", "nearest", F.explode("near").alias("x"))
    w = F.exp(-F.greatest(F.lit(0.0), F.col("x.d") - F.col("nearest")) / F.col("scale"))
    ways = each.select(F.least("u", "x.v").alias("u"), F.greatest("u", "x.v").alias("v"), F.round(w, 9).alias("w"))
    both = ways.groupBy("u", "v").agg(F.min("w").alias("a"), F.max("w").alias("b"), F.count(F.lit(1)).alias("n"))
    return both.select("u", "v", F.when(F.col("n") > 1, F.col("a") + F.col("b") - F.col("a") * F.col("b")).otherwise(F.col("a")).alias("w"))


def _whole(c: Column) -> Column:
    return F.round(c / UNIT).cast("long")


def layout(graph: DataFrame, start: DataFrame, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """ord, x, y after all epochs, from the places (ord, x, y) to start from, ord from 0 without gaps. The same for the same seed."""
    edges = written(_weights(graph))
    both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    places = written(start.select("ord", "x", "y"))
    n = places.count()
    a, b = CURVE_A, CURVE_B
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        here, there = places.select(F.col("ord").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1")), places.select(F.col("ord").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
        d2 = dx * dx + dy * dy
        held = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
        pull = F.when(d2 > 0, -2 * a * b * F.pow(d2, b - 1) / (1 + a * F.pow(d2, b))).otherwise(0.0) * F.col("w")
        # places are broadcast as long as they are few, so that an epoch is one aggregation
        here, there = counted(here), counted(there)
        pulled = both.join(here, "u").join(there, "v").select(F.col("u").alias("ord"), _whole(held(pull * dx)).alias("fx"), _whole(held(pull * dy)).alias("fy"))
        moves = pulled
        if n > 1:
            sampled = F.array(*[F.pmod(F.col("ord") + 1 + F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(i), "ord"), F.lit(n - 1)), F.lit(n)) for i in range(PUSHED_FROM)])
            pairs = places.select(F.col("ord").alias("u"), F.explode(sampled).alias("v"))
            push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, b)))
            pushed = pairs.join(here, "u").join(there, "v").select(F.col("u").alias("ord"), _whole(held(push * dx)).alias("fx"), _whole(held(push * dy)).alias("fy"))
            moves = pulled.unionByName(pushed)
        forces = moves.groupBy("ord").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        step = lambda c: F.round(F.col(c) + F.coalesce(F.col(f"f{c}"), F.lit(0)) * (UNIT * rate * 0.2), 9).alias(c)
        # each epoch reads the one before three times: it is written
        places = written(places.join(forces, "ord", "left").select("ord", step("x"), step("y")))
    return places


def coverage_layout(rows: DataFrame, key: str = "path", embedding: str = "embedding", k: int = NEIGHBOURS, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """key, x, y of rows: neighbours by embedding stand together. The same for the same seed.

    Embeddings are brought to 50 principal components at most before neighbours are looked for, and the first two of these are
    where the layout starts. Rows without an embedding have no place. Copies have one place to start from and drift little.
    An empty table gives an empty result, a single row the place 0, 0.
    """
    known = rows.filter(F.col(embedding).isNotNull()).select(F.col(key).alias("key"), F.col(embedding).alias("embedding"))
    placed = kept(scan_order(known, [F.col("key"), F.hash("embedding")]))
    n = placed.count()
    if n < 3:
        return placed.select(F.col("key").alias(key), F.col("ord").cast("double").alias("x"), F.lit(0.0).alias("y"))
    size = placed.select(F.size("embedding")).first()[0]
    reduced = kept(principal_components(placed.select("ord", "embedding"), "ord", "embedding", min(50, n - 1, size)))
    graph = neighbour_graph(reduced, k)
    first = F.get("vector", F.lit(0)), F.coalesce(F.get("vector", F.lit(1)), F.lit(0.0))
    ends = reduced.agg(F.max(F.greatest(*[F.abs(c) for c in first]))).first()[0] or 1.0
    scale = 10.0 / max(ends, 1e-12)
    start = reduced.select("ord", *[F.round(c * scale, 6).alias(name) for c, name in zip(first, ("x", "y"), strict=True)])
    places = layout(graph, start, epochs, seed)
    return placed.select("ord", "key").join(places, "ord").select(F.col("key").alias(key), "x", "y")


#: Above so many points the layout shows more than two components do.
FEW = 30


def plane_of(rows: DataFrame, key: str = "path", embedding: str = "embedding") -> tuple[str, DataFrame]:
    """How the points are laid out, and their places: `pca` for up to FEW points, else `layout`."""
    return ("pca", principal_plane(rows, key, embedding)) if rows.count() <= FEW else ("layout", coverage_layout(rows, key, embedding))
