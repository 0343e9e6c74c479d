import math

import numpy as np
import pytest

from corpusmill.llm.topk import integer_vectors, sorted_vectors, top_products


def brute(rows, k):
    """(query id, rank, id, score) over all pairs of usable rows."""
    usable = []
    for place, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((place, i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for place, i, v in usable:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j, p) for p, j, w in usable if p != place)
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5, **options):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = sorted_vectors(docs)
    got = top_products(vectors, vectors.filter("vec_id % 50 = 0"), k, **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_random_vectors_in_small_chunks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.1, (700, 12)).astype(np.float32))]
    assert found(spark, rows) == found(spark, rows, query_cells=36, seeds=7) == brute(rows, 5)


def test_clusters_are_pruned_by_coordinates(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(8)[rng.integers(0, 8, 600)] * rng.uniform(0.5, 3, (600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate((centres + rng.normal(0, 0.01, centres.shape)).astype(np.float32))]
    assert found(spark, rows) == brute(rows, 5)


def test_ties_repeated_rows_and_few_candidates(spark):
    same = [(i, [0.5, 0.25]) for i in range(3000)]
    assert found(spark, same) == brute(same[:1], 5) + sorted(
        (q, r, i, 128 * 128 + 64 * 64) for q in range(0, 3000, 50)
        for r, i in enumerate([x for x in range(6) if x != q][:5], 1))
    few = [(0, [1.0]), (7, [-1.0]), (7, [-1.0]), (0, [2.0])]
    assert found(spark, few) == brute(few, 5)


def test_unusable_and_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (1, [None, 1.0]), (2, [float("inf"), 0.0]),
            (None, [9.0, 9.0]), (3, []), (4, [0.0, 0.0]), (5, [-1.0]), (150, [-0.3, 0.7, 5.0]), (6, [1e-9, -1e-9])]
    assert found(spark, rows) == brute(rows, 5)
    huge = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [1.0, 1.0])]
    got = found(spark, huge)
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2)]
    assert got[0][3] == 2**63 - 1


@pytest.mark.parametrize("rows", [[], [(1, [1.0]), (2, [2.0])], [(0, [1.0])]])
def test_nothing_to_find(spark, rows):
    assert found(spark, rows) == []


def test_floor_of_scaled_components(spark):
    docs = spark.createDataFrame([(1, [-0.001, 0.0039, 0.00390625])], "vec_id long, embedding array<double>")
    assert integer_vectors(docs).first().v == [-1, 0, 1]
