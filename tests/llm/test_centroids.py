import hashlib
import math
import random

import numpy as np
import pytest

from tallyspark.llm.centroids import LIMIT, Simplex, cluster_vectors, nearest

SHAPE = "vec_id long, embedding array<double>, cluster string, id int"


def brute(rows, dim, k, rounds):
    """Floored means by plain integers; rows: (id, components or None)."""
    whole = [(i, [max(-LIMIT, min(LIMIT, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)
    centroids = [v for _, v in first[:k]]
    if not centroids:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(x) // len(g) for x in zip(*g)]
    got = [(i, near(v)) for i, v in whole]
    of = lambda j: sum(d for _, (d, c) in got if c == j)
    return [(i, c, d, of(c), sum(x[0] for _, x in got), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, (d, c) in got]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SHAPE).repartition(3)
    got = cluster_vectors(df, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("refresh", [0.0, 0.5, 1.0])
def test_rounds_match_brute_force(spark, refresh):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.5) for x in centres[i % 5]]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one very common vector
    rows += [(7, rows[3][1]), (None, rows[4][1]), (2000, None), (2001, [1.0] * 5), (2002, [1.0] * 5 + [None]), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, [1e300] * 6), (2006, [-1e300] * 6)]
    assert run(spark, rows, dim=6, k=9, refresh=refresh) == sorted(brute(rows, 6, 9, 3), key=repr)


def test_equal_vectors_few_vectors_and_empty_tables(spark):
    same = [(i, [0.5, -0.25]) for i in range(40)]
    assert run(spark, same, dim=2, k=4) == sorted(brute(same, 2, 4, 3), key=repr)  # ties go to centroid 0, the others stay
    assert run(spark, same[:2], dim=2, k=4) == sorted(brute(same[:2], 2, 4, 3), key=repr)
    assert run(spark, [], dim=2) == [] and run(spark, [(None, [1.0, 2.0])], dim=2) == []


def test_bounds_lose_no_centroid():
    rng = np.random.default_rng(1)
    for scale in (1, 50, LIMIT):
        rows = rng.integers(-scale, scale + 1, (500, 64))
        centroids = np.vstack([rows[:8], rows[:4], rng.integers(-scale, scale + 1, (4, 64))])
        for pivots in (rows[:1], rows[:8], np.vstack([rows[:6], rows[:3], (rows[:1] + rows[1:2]) // 2])):
            simplex = Simplex(pivots)
            which, best, looked = nearest(rows, simplex.apexes(rows), centroids, simplex)
            gaps = ((rows[:, None] - centroids[None]) ** 2).sum(2)
            assert (which == gaps.argmin(1)).all() and (best == gaps.min(1)).all() and looked <= gaps.size
    own = Simplex(centroids)
    assert nearest(rows, own.apexes(rows), centroids, own)[2] < 2.5 * len(rows)  # pivots are the centroids: one is left, or equal ones
