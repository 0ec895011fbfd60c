import hashlib
import math

import numpy as np
import pytest
from compare import compare, connect

from cohortspark.llm import clusters
from cohortspark.llm.queries import LLM

FOLDER = "/root/testdata/sf0.001"


def plain(rows, components, count, rounds, scale=256, seed=2):
    """All distances in Python integers."""
    kept = [
        (i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)
    ]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=rank)[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        labels = [nearest(v)[1] for _, v in kept]
        for n in range(len(centres)):
            own = [v for (_, v), label in zip(kept, labels) if label == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    return sorted(((i, n, d) for i, d, n in found), key=str), centres


def frame(spark, rows):
    schema = "vec_id long, embedding array<float>, cluster int, distance string, `a.b` string"
    return spark.createDataFrame([(i, v, 7, "x", "y") for i, v in rows], schema)


def test_agrees_with_sql(spark):
    name = "op11_centroid_clusters"
    assert compare(spark, connect(FOLDER), LLM.queries[name], LLM.sql[name], FOLDER) == ""


def test_against_all_distances(spark):
    draw = np.random.default_rng(3)
    points = np.round(draw.normal(size=(300, 4)) * 4) / 64  # few values: many ties
    rows = [(n, p.tolist()) for n, p in enumerate(points.astype("float32"))]
    # a third of all rows is one vector; some ids repeat or are missing; some vectors are no use
    rows += [(1000 + n, rows[0][1]) for n in range(150)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, [9.0] * 4)]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4)]
    rows += [(905, [float("inf"), 0.0, 0.0, 0.0]), (906, [-0.001] * 4)]
    found, centres = clusters.cluster_vectors(frame(spark, rows).repartition(5), components=4, clusters=9, rounds=3)
    want, wanted_centres = plain(rows, 4, 9, 3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert centres.tolist() == wanted_centres


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.25, -0.5]), (3, None)]
    found, centres = clusters.cluster_vectors(frame(spark, rows), components=2)
    assert sorted(map(tuple, found.select("vec_id", "distance").collect())) == [(1, 0), (2, 0)] and len(centres) == 2
    for none in (rows[:0], rows[2:]):
        table = clusters.with_inertia(*clusters.cluster_vectors(frame(spark, none), components=2))
        assert table.count() == 0 and table.columns == [
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
        ]


def test_vectors_too_large_for_exact_distances_raise(spark):
    rows = [(1, [1e9, 0.0]), (2, [0.0, 0.0])]
    with pytest.raises(Exception, match="is over"):
        clusters.cluster_vectors(frame(spark, rows), components=2)


@pytest.mark.parametrize("size", [1, 1000, 1 << 27])
def test_bounds_leave_no_nearest_centroid_out(size):
    draw = np.random.default_rng(size)
    points = draw.integers(-size, size + 1, (400, 8))
    centres = np.concatenate([points[:30], points[:3]])  # equal centroids tie
    pivots = clusters.choose_pivots(centres, 6)
    tables = clusters.to_pivots(points, pivots), clusters.to_pivots(centres, pivots)
    label, distance, taken = clusters.nearest_centroids(points, tables[0], centres, tables[1])
    every = np.stack([clusters.exact_squares(points, c[None, :]) for c in centres], axis=1)
    assert (label == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert taken <= every.size


def test_bounds_save_distances():
    draw = np.random.default_rng(1)
    middles = draw.integers(-5000, 5000, (40, 64))
    points = np.repeat(middles, 50, axis=0) + draw.integers(-50, 51, (2000, 64))
    pivots = clusters.choose_pivots(middles, clusters.PIVOTS)
    tables = clusters.to_pivots(points, pivots), clusters.to_pivots(middles, pivots)
    *_, taken = clusters.nearest_centroids(points, tables[0], middles, tables[1])
    assert taken < 2 * len(points)
