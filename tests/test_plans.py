"""What the plans must look like for large tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import collection
from corpusmill.operators.lexical import bm25_topk, build_index, build_postings, document_frequencies, score_bm25
from corpusmill.operators.vector import vector_topk
from corpusmill.runtime import scratch_dir
from corpusmill.sources.index_store import as_corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "docs")
    spark.range(200).select(
        F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("common word"), (F.col("id") % 20)).alias("content"),
        F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"),
        (F.col("id") % 5).cast("string").alias("kind"), F.timestamp_seconds(F.col("id") * 86400).alias("day"),
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "common word3 word4 word4", [0.5, 0.5]), (2, "word7 none", [0.1, 0.9])],
                                 "query_id long, query string, query_vec array<float>")


def test_predicates_and_columns_reach_the_scan(table):
    found = plan(collection.attribute_search(table, {"kind": "3"}, {"content": "word1"}).select("doc_id"))
    assert "EqualTo(kind,3)" in found and "StringContains(content,word1)" in found and "embedding" not in found
    dated = plan(collection.filter_base_date(table, "day", "19700103", "19700105").select("doc_id"))
    assert "GreaterThanOrEqual(day" in dated and "LessThan(day" in dated


def test_postings_take_one_shuffle(table):
    assert plan(build_postings(as_corpus(table))).count("Exchange") == 1
    assert "partial_count" in plan(document_frequencies(as_corpus(table)))


def test_small_changes_do_not_shuffle_the_corpus(table):
    assert "Exchange hashpartitioning" not in plan(collection.delete(table, table.limit(3)))
    few = table.filter("kind = '1'").drop("day")
    assert "Exchange hashpartitioning" not in plan(collection.upsert(table.drop("day"), few))


def test_top_k_is_limited_before_the_shuffle(table, asked):
    corpus = as_corpus(table)
    for df in (vector_topk(asked, corpus, 3), bm25_topk(asked, build_index(corpus), 3)):
        text = plan(df)
        assert "WindowGroupLimit" in text and "Partial" in text
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_shuffled_scoring_equals_broadcast_scoring(table, asked, monkeypatch):
    index = build_index(as_corpus(table))
    want = {(r.query_id, r.doc_id): round(r.score, 9) for r in score_bm25(asked, index, small=True).collect()}
    monkeypatch.setattr("corpusmill.runtime.HOT_ROWS", 15)  # "common" and others count as hot
    got = score_bm25(asked, index, small=False)
    assert "_salt" in plan(got)
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in got.collect()} == want


def test_scratch_folder(spark):
    def session(master, conf):
        context = SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId="app-1")
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf))

    assert scratch_dir(session("yarn", "hdfs://shared/tmp/"), "x").startswith("hdfs://shared/tmp/x-")
    with pytest.raises(ValueError):
        scratch_dir(session("yarn", None), "x")
    first, second = (scratch_dir(session("local[2]", None), "x") for _ in range(2))
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
