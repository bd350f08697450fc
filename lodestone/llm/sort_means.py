"""Centroid clustering of integer vectors by sort-means.

Each round orders, for every centroid, the other centroids by their distance
from it. A vector starts at the centroid that it had before and looks through
the others in that order; it stops at the first one that is further from its own
centroid than twice its distance to it, since by the triangle inequality neither
that one nor any later one can be nearer or as near.

Vectors are kept in blocks, one row each, that hold the vectors, their centroids
and the sums that the next centroids need. A round reads the blocks and writes
the new ones without a shuffle; only sums of blocks move.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import remove, stash_at

BLOCK = 4096  # vectors of a block
#: Components up to this fit 64-bit arithmetic in distances and their fourfold; larger ones take Python's integers.
NARROW = 1 << 26
JOINED = 32  # tasks that sum up what all others give, and rows that come to the driver

_STATE = "ids array<bigint>, wide boolean, data string, narrow binary, cluster binary, sums string"


def _is_kept(dims: int) -> F.Column:
    """True for vectors of ``dims`` components, all there and finite."""
    x = F.col("embedding")
    return F.coalesce((F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))), F.lit(False))


def _scaled(x: float, scale: int) -> int:
    """floor(scale * x) without rounding."""
    n, d = x.as_integer_ratio()
    return n * scale // d


def _integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of all components: 64-bit numbers, or Python's if any is beyond NARROW."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * scale)
    if (np.abs(out) <= NARROW).all():
        return out.astype(np.int64)
    return np.array([[_scaled(float(x), scale) for x in v] for v in vectors], object)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return (apart * apart).sum(axis=-1)


def nearest(points: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point, the smaller number on ties, and its squared distance.

    ``before`` holds the centroid that each point had.
    """
    if points.dtype != centroids.dtype:
        points, centroids = points.astype(object), centroids.astype(object)
    cluster, distance = before.copy(), np.zeros(len(points), points.dtype)
    for own in np.unique(before).tolist():
        rows = np.flatnonzero(before == own)
        mine = points[rows]
        here = _squared(mine, centroids[own])
        best, at, active = here.copy(), np.full(len(rows), own), np.arange(len(rows))
        gaps = _squared(centroids, centroids[own])
        for other in sorted((j for j in range(len(centroids)) if j != own), key=lambda j: (gaps[j], j)):
            active = active[(4 * here[active] >= gaps[other]).astype(bool)]  # squared: twice the distance
            if not len(active):
                break
            found = _squared(mine[active], centroids[other])
            nearer = ((found < best[active]) | ((found == best[active]) & (other < at[active]))).astype(bool)
            best[active[nearer]], at[active[nearer]] = found[nearer], other
        cluster[rows], distance[rows] = at, best
    return cluster, distance


def _joined_sums(texts: list[str]) -> str:
    """Sums of sums: for each centroid the number of its vectors, their components' sums and their distances' sum."""
    total: dict[str, list] = {}
    for text in texts:
        for k, (n, sums, cost) in json.loads(text).items():
            own = total.setdefault(k, [0, [0] * len(sums), 0])
            own[0], own[1], own[2] = own[0] + n, [a + b for a, b in zip(own[1], sums, strict=True)], own[2] + cost
    return json.dumps(total)


def _block(ids: pa.Array, points: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    wide = points.dtype == object
    sums = {}
    for k in np.unique(cluster).tolist():
        own = cluster == k
        sums[k] = [int(own.sum()), [int(x) for x in points[own].sum(axis=0)], sum(map(int, distance[own].tolist()))]
    values = [
        pa.array([ids.to_pylist()], pa.list_(pa.int64())),
        pa.array([bool(wide)], pa.bool_()),
        pa.array([json.dumps(points.tolist()) if wide else None], pa.string()),
        pa.array([None if wide else points.astype(np.int32).tobytes()], pa.binary()),
        pa.array([cluster.astype(np.int32).tobytes()], pa.binary()),
        pa.array([json.dumps(sums)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(values, ["ids", "wide", "data", "narrow", "cluster", "sums"])


def _points(row: dict, dims: int) -> np.ndarray:
    return np.array(json.loads(row["data"]), object) if row["wide"] else np.frombuffer(row["narrow"], np.int32).reshape(-1, dims).astype(np.int64)


def _centroids(values: list[list[int]]) -> np.ndarray:
    narrow = all(abs(x) <= NARROW for c in values for x in c)
    return np.array(values, np.int64 if narrow else object)


def _first_blocks(kept: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> DataFrame:
    def run(batches):
        c = _centroids(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                points = _integers(vectors, scale)
                yield _block(part.column(0), points, *nearest(points, np.zeros(len(points), np.int64), c))

    return kept.mapInArrow(run, _STATE)


def _next_blocks(state: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    def run(batches):
        c = _centroids(centroids)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                points, before = _points(row, dims), np.frombuffer(row["cluster"], np.int32).astype(np.int64)
                yield _block(pa.array(row["ids"], pa.int64()), points, *nearest(points, before, c))

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame) -> dict[int, list]:
    """The sums of all blocks; at most JOINED rows, each of one entry a centroid, come to the driver."""

    def run(batches):
        texts = [t for batch in batches for t in [_joined_sums(batch.column(0).to_pylist())]]
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([_joined_sums(texts)], pa.string())], ["sums"])

    rows = state.select("sums").mapInArrow(run, "sums string").repartition(JOINED).mapInArrow(run, "sums string").collect()
    return {int(k): v for k, v in json.loads(_joined_sums([r["sums"] for r in rows])).items()}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Cluster, distance and the clusters' sums of every vector that is kept.

    Kept are vectors of exactly ``dims`` components, none null or not finite; a
    component x counts as floor(``scale`` * x). The first centroids are the ``k``
    kept vectors with the least SHA-256 of ``seed:vec_id``, or all of them where
    there are fewer. Each of ``rounds`` rounds gives every vector to the nearest
    centroid (the smaller number on ties) and moves every centroid that has
    vectors to the floor of their mean; one without vectors stays where it is.
    Then vectors are given out once more. All arithmetic is exact.

    Columns: vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256. A squared distance or a sum that no long holds is null.
    Repeated rows are vectors of their own, and rows that share a vec_id stand
    in the order of their components among the first centroids. A null vec_id
    counts as an empty text there and stays null. An empty table, or one without
    a vector to keep, gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_is_kept(dims))
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), F.col("embedding")]
    centroids = [[_scaled(x, scale) for x in r["embedding"]] for r in kept.orderBy(*order).limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, path = stash_at(_first_blocks(kept, centroids, dims, scale), "clusters")
    for _ in range(rounds):
        for j, (n, sums, _cost) in _sums(state).items():
            centroids[j] = [s // n for s in sums]
        state, fresh = stash_at(_next_blocks(state, centroids, dims), "clusters")
        remove(spark, path)  # the new table no longer needs it
        path = fresh
    costs = {j: v[2] for j, v in _sums(state).items()}
    inertia = sum(costs.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def rows(batches):
        fits = lambda x: x if x < 1 << 63 else None
        c = _centroids(centroids)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                points, own = _points(row, dims), np.frombuffer(row["cluster"], np.int32)
                if points.dtype != c.dtype:
                    points = points.astype(object)
                distance = _squared(points, c.astype(points.dtype)[own])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(own, pa.int32()),
                        pa.array([fits(int(x)) for x in distance.tolist()], pa.int64()),
                        pa.array([fits(costs[j]) for j in own.tolist()], pa.int64()),
                        pa.array([fits(inertia)] * len(own), pa.int64()),
                        pa.array([digests[j] for j in own.tolist()], pa.string()),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return state.drop("sums").mapInArrow(rows, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
