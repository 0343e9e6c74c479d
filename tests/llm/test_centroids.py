import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm.centroids import Centroids, _pieces, cluster_vectors


def brute(rows, n_centroids, rounds, dims):
    """The same clustering by plain loops over Python integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]

    def first(row):
        i, v = row
        return (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest(), v)

    centres = [v for _, v in sorted(kept, key=first)[:n_centroids]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c
                   for j, c in enumerate(centres)]
    ends = [(i, *nearest(v)) for i, v in kept]
    longest = 2**63 - 1
    inertia = Counter()
    for _, d, j in ends:
        inertia[j] += min(d, longest)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, min(d, longest), min(inertia[j], longest), min(sum(inertia.values()), longest), digest[j])
                   for i, d, j in ends)


def found(spark, rows, kind="float", **options):
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows],
                                 f"vec_id long, embedding array<{kind}>, cluster string, v double")
    return Counter(tuple(r) for r in cluster_vectors(docs, **options).collect())


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_clusters_of_random_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.3, (9, 16))
    rows = as_floats([(i, (centres[i % 9] + rng.normal(0, 0.1, 16)).tolist()) for i in range(900)])
    assert found(spark, rows, n_centroids=12, dims=16) == brute(rows, 12, 5, 16)


def test_search_measures_few_and_agrees_with_all():
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (50, 1)) + rng.integers(-20, 20, (50, 64))
    v = (centres[rng.integers(0, 50, 2000)] + rng.integers(-4, 5, (2000, 64))).astype(float)
    known = Centroids(centres.tolist())
    number, distance, measured = known.nearest(v)
    every = ((v[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and distance == every.min(axis=1).astype(int).tolist()
    assert measured < 0.3 * len(v) * len(centres)


def test_ties_go_to_the_smaller_number():
    # all at the same distance from the zero vector, with equal and with different sums
    known = Centroids([[2, 0], [0, 2], [-2, 0], [0, -2], [2, 0]])
    assert known.nearest(np.zeros((1, 2)))[:2] == (np.array([0]), [4])
    known = Centroids([[0, -2], [2, 0], [2, 0], [0, 2]])
    assert known.nearest(np.array([[1.0, 0.0], [0.0, 0.0]]))[0].tolist() == [1, 0]


def test_odd_vectors(spark):
    rows = as_floats([(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]),
                      (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (None, [9.0, 9.0]), (8, [0.0, 0.0]), (8, [0.5, 0.0]),
                      (8, [0.5, 0.0]), (9, [-0.3, 5.0]), (10, [1e-9, -1e-9]), (None, [9.0, 9.5])])
    for n in (1, 3, 40):
        assert found(spark, rows, n_centroids=n, dims=2) == brute(rows, n, 5, 2)


def test_components_of_any_size(spark):
    rows = [(i, [10.0 ** (3 * (i % 9)) * s, float(i)]) for i in range(27) for s in (1, -1)]
    assert found(spark, rows, "double", n_centroids=5, dims=2) == brute(rows, 5, 5, 2)
    assert found(spark, [*rows, (99, [1e308, 1.0])], "double", n_centroids=5, dims=2) == brute(rows, 5, 5, 2)


@pytest.mark.parametrize("rows", [[], [(1, [1.0]), (2, None)]])
def test_nothing_to_cluster(spark, rows):
    assert not found(spark, rows)


def test_pieces_add_up():
    for x in (0, -1, 5, -(1 << 70) - 3, (1 << 100) + 7, (1 << 62) - 1, -(1 << 62)):
        parts = _pieces(x)
        assert sum(p << (40 * i) for i, p in enumerate(parts)) == x and all(-(1 << 63) <= p < 1 << 63 for p in parts)
