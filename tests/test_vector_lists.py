import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import vector_lists
from corpusmill.operators.vector import recall, vector_topk
from corpusmill.operators.vector_lists import (candidates, save_vector_lists, search_lists, train_centroids,
                                               vector_lists as build)


def frame(spark, rows, name="doc_id", vector="embedding"):
    kind = "string" if name == "doc_id" else "long"
    return spark.createDataFrame([(str(i) if kind == "string" else i, None if v is None else [float(x) for x in v])
                                  for i, v in rows], f"{name} {kind}, {vector} array<float>")


def hits(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def spread():
    return list(enumerate(np.random.default_rng(1).normal(size=(1500, 32))))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    return [(i, centres[i % 30] + rng.normal(scale=0.05, size=32)) for i in range(1500)]


@pytest.mark.parametrize("kind", ["spread", "clustered"])
@pytest.mark.parametrize("lists", [1, 7, None])
def test_hits_are_those_of_all_vectors(spark, request, kind, lists):
    rows = request.getfixturevalue(kind)
    docs, asked = frame(spark, rows), frame(spark, rows[::50], "query_id", "query_vec")
    assert hits(search_lists(asked, build(docs, lists), 10)) == hits(vector_topk(asked, docs, 10))


def test_few_vectors_are_scored(spark, spread):
    docs, asked = frame(spark, spread), frame(spark, spread[::50], "query_id", "query_vec")
    pairs = 30 * len(spread)
    small = candidates(asked, build(docs.limit(500)), 10).count() / (30 * 500)
    large = candidates(asked, build(docs), 10).count() / pairs
    assert large < 0.03 and large < small


def test_lists_out_of_reach_are_not_read(spark, clustered, tmp_path, monkeypatch):
    docs, asked = frame(spark, clustered), frame(spark, clustered[:2], "query_id", "query_vec")
    lists = save_vector_lists(docs, str(tmp_path / "codes"), 30, parts=16)
    read = []
    chosen = vector_lists._in_lists

    def watched(lists, wanted):
        read.append(wanted.any(axis=0).sum())
        return chosen(lists, wanted)

    monkeypatch.setattr(vector_lists, "_in_lists", watched)
    assert hits(search_lists(asked, lists, 10)) == hits(vector_topk(asked, docs, 10))
    assert max(read) < 15
    plan = chosen(lists, np.eye(2, 30, dtype=bool))._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [In(list" in plan
    assert "embedding" not in plan


def test_chunks_and_shuffled_joins_give_the_same(spark, spread, monkeypatch):
    docs, asked = frame(spark, spread[:400]), frame(spark, spread[:40], "query_id", "query_vec")
    want = hits(vector_topk(asked, docs, 5))
    monkeypatch.setattr(vector_lists, "MATRIX_BYTES", 4000)
    monkeypatch.setattr("corpusmill.runtime.BROADCAST_ROWS", 0)
    assert hits(search_lists(asked, build(docs), 5)) == want


def test_nearest_lists_only_is_approximate(spark, spread):
    docs, asked = frame(spark, spread), frame(spark, spread[::50], "query_id", "query_vec")
    lists, exact = build(docs, 20), vector_topk(asked, docs, 10)
    shares = [recall(search_lists(asked, lists, 10, most_lists=m), exact).first()["recall"] for m in (1, 6, 20)]
    assert shares[0] < shares[1] < shares[2] == 1.0


def test_ties_zero_vectors_and_missing_ones(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [0.0, 0.0]), (51, None), (52, [-1.0, 0.0]), (53, [0.0, 1.0])]
    asked = frame(spark, [(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [-1.0, 0.2])], "query_id", "query_vec")
    docs = frame(spark, rows)
    for n in (1, 5, 60):
        assert hits(search_lists(asked, build(docs), n)) == hits(vector_topk(asked, docs, n))


def test_no_vectors(spark):
    asked = frame(spark, [(1, [1.0, 0.0])], "query_id", "query_vec")
    assert search_lists(asked, build(frame(spark, [(1, None)])), 3).count() == 0
    assert search_lists(asked, build(frame(spark, [])), 3).count() == 0
    assert search_lists(asked.filter("query_id = 9"), build(frame(spark, [(1, [1.0, 0.0])])), 3).count() == 0
    assert train_centroids(frame(spark, [])).shape == (0, 0)


def test_vectors_of_different_dimensions_are_refused(spark):
    docs = frame(spark, [(1, [1.0, 0.0])])
    with pytest.raises(Exception, match="dimensions"):
        search_lists(frame(spark, [(1, [1.0, 0.0, 0.0])], "query_id", "query_vec"), build(docs), 1).collect()


def test_training_reads_a_bounded_sample(spark, clustered):
    docs = frame(spark, clustered)
    assert train_centroids(docs, sample=100).shape == (39, 32)
    assert train_centroids(docs, 5000, sample=50).shape == (50, 32)
    listed = build(docs).codes.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    assert listed.agg(F.sum("n")).first()[0] == len(clustered)
