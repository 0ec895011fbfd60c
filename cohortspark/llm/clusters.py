"""Exact centroid clustering of integer vectors with a LAESA pivot table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, record_batch, slices, stage

COMPONENTS = 64
#: Components are floor(SCALE * x).
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Fixed points to which every vector's distance is stored.
PIVOTS = 12
#: Largest component, scaled; distances of such vectors fit in 64 bits.
LARGEST = 1 << 27
#: Room for rounding in the stored distances, as a share of the distances compared.
ROUNDING = 1e-9
#: Vectors that are compared at once inside a task.
ROWS = 2048


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """``vec_id long, vector array<long>`` of the rows whose vector can be used."""
    values = column(vector_col).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(values, lambda x: F.floor(x * F.lit(float(scale))))
    small = F.forall(values, lambda x: F.abs(x) * F.lit(float(scale)) <= F.lit(float(LARGEST)))
    checked = F.when(small, scaled).otherwise(F.raise_error(F.lit(f"a component times {scale} is over {LARGEST}")))
    return vectors.filter((F.size(values) == components) & finite).select(
        column(id_col).cast("long").alias("vec_id"), checked.alias("vector")
    )


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least hash of ``seed:vec_id``, in the order of the hash.

    Rows of one id follow their components; rows without an id come last.
    """
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(rank.asc_nulls_last(), "vector").limit(clusters).collect()
    return np.array([r.vector for r in chosen], np.int64)


def exact_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact in 64-bit integers."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def choose_pivots(points: np.ndarray, pivots: int) -> np.ndarray:
    """Points far from each other: the first, then always the one farthest from those chosen."""
    chosen = points[:1]
    nearest = exact_squares(points, points[:1])
    while len(chosen) < pivots and nearest.any():
        chosen = np.concatenate([chosen, points[[int(nearest.argmax())]]])
        nearest = np.minimum(nearest, exact_squares(points, chosen[-1:]))
    return chosen


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all points to all pivots."""
    return np.sqrt(np.stack([exact_squares(points, p[None, :]) for p in pivots], axis=1).astype(float))


def nearest_centroids(
    points: np.ndarray, table: np.ndarray, centroids: np.ndarray, centre_table: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid, and how many distances it took.

    The difference of two distances to a pivot is at most the distance between the two
    points, so the largest difference over the pivots bounds each centroid from below.
    Centroids are tried from the least bound on; those whose bound is over the best distance
    found so far are out, all others get their exact distance. Ties go to the smaller number.
    """
    bound = np.zeros((len(points), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, p, None] - centre_table[None, :, p]), out=bound)
    # stored distances are rounded: a bound must not pass the true distance
    bound -= ROUNDING * (table.max(axis=1)[:, None] + centre_table.max(axis=1)[None, :] + 1)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(points), np.iinfo(np.int64).max)
    label = np.zeros(len(points), np.int64)
    alive, taken = np.arange(len(points)), 0
    for step in range(len(centroids)):
        tried = order[alive, step]
        alive = alive[bound[alive, tried] <= np.sqrt(best[alive].astype(float)) * (1 + ROUNDING)]
        if not len(alive):
            break
        tried = order[alive, step]
        found = exact_squares(points[alive], centroids[tried])
        taken += len(alive)
        nearer = (found < best[alive]) | ((found == best[alive]) & (tried < label[alive]))
        best[alive[nearer]], label[alive[nearer]] = found[nearer], tried[nearer]
    return label, best, taken


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Stored ``vec_id, vector binary, pivots binary``: distances to the pivots, found once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, ROWS):
            points = piece.column("vector").flatten().to_numpy().reshape(len(piece), -1)
            table = to_pivots(points, pivots)
            yield record_batch({
                "vec_id": piece.column("vec_id"),
                "vector": pa.array([p.tobytes() for p in points], pa.binary()),
                "pivots": pa.array([t.tobytes() for t in table], pa.binary()),
            })

    return stage(rows.mapInArrow(run, "vec_id long, vector binary, pivots binary"), "pivot-table")


def unpack_rows(cells: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), dtype).reshape(len(cells), -1)


def assigned(stored: DataFrame, pivots: np.ndarray, centroids: np.ndarray, make, schema: str) -> DataFrame:
    """What ``make(batch, points, labels, distances)`` yields for the batches of a pivot table."""
    centre_table = to_pivots(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, ROWS):
            points = unpack_rows(piece.column("vector"), "int64")
            table = unpack_rows(piece.column("pivots"), "float64")
            label, distance, _ = nearest_centroids(points, table, centroids, centre_table)
            yield make(piece, points, label, distance)

    return stored.mapInArrow(run, schema)


def next_centroids(stored: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; empty clusters keep their centroid.

    Tasks send a sum for each cluster and batch, Spark adds them up; the driver gets one row
    for each cluster.
    """
    width = centroids.shape[1]

    def make(_, points: np.ndarray, label: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        found, inverse = np.unique(label, return_inverse=True)
        sums = np.zeros((len(found), width), np.int64)
        np.add.at(sums, inverse, points)
        return record_batch({
            "cluster": pa.array(found, pa.int64()),
            "count": pa.array(np.bincount(inverse), pa.int64()),
            **{f"s{n}": pa.array(sums[:, n]) for n in range(width)},
        })

    names = [f"s{n}" for n in range(width)]
    schema = "cluster long, count long, " + ", ".join(f"{n} long" for n in names)
    parts = assigned(stored, pivots, centroids, make, schema)
    totals = parts.groupBy("cluster").agg(*(F.sum(n).alias(n) for n in ("count", *names)))
    moved = centroids.copy()
    for row in totals.collect():
        moved[row.cluster] = [row[n] // row["count"] for n in names]
    return moved


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, pivots: int = PIVOTS,
) -> tuple[DataFrame, np.ndarray]:
    """Stored ``vec_id, cluster, distance`` of every vector, and the final centroids.

    Components are ``floor(scale * x)``; centroids start as the vectors of least hash, and each
    round assigns all vectors and moves the centroids to the floor of the mean. ``distance`` is
    squared; ties go to the smaller cluster. Vectors of another length, and those with a null
    or non-finite component, are left out; components over 2**27 when scaled raise an error,
    because distances would not fit in 64 bits. A null id stays null and is chosen as a
    first centroid after all others; repeated rows are separate vectors; with fewer vectors
    than clusters every vector starts one; other columns are not read; no vectors give an
    empty table and no centroids. Vectors never travel: a round sends one sum per cluster
    and batch, combined before the exchange, and a hot cluster is only one such sum.
    """
    rows = integer_vectors(vectors, id_col, vector_col, components, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance").limit(0), centroids.reshape(0, components)
    fixed = choose_pivots(centroids, pivots)
    stored = pivot_table(rows, fixed)
    for _ in range(rounds):
        centroids = next_centroids(stored, fixed, centroids)

    def make(piece: pa.RecordBatch, _: np.ndarray, label: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        return record_batch({
            "vec_id": piece.column("vec_id"),
            "cluster": pa.array(label, pa.int32()),
            "distance": pa.array(distance, pa.int64()),
        })

    found = assigned(stored, fixed, centroids, make, "vec_id long, cluster int, distance long")
    return stage(found, "clusters"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia, inertia`` and ``centroid_sha256`` to assigned vectors.

    There is one row per cluster to add, so these travel to the tasks.
    """
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [
        (n, total, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[n].tolist())).encode()).hexdigest())
        for n, total in sums.items()
    ]
    facts = found.sparkSession.createDataFrame(rows, schema)
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", *facts.columns[1:])
