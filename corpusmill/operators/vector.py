"""Vector side of the search: exact nearest neighbours by cosine.

Exact search is a scan of the corpus vectors. A query batch of checked size is sent to every
partition, where one matrix product per Arrow batch replaces row-wise arithmetic, and only the best
rows per query leave the partition. A larger query set comes in chunks of that size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import scores
from corpusmill.runtime import measure, top_per_group

MATRIX_BYTES = 64 << 20      # query vectors sent to the tasks
PRODUCT_CELLS = 4_000_000    # scores held at once by a task
HIT_SCHEMA = "query_id long, doc_id string, score double"


def unit_rows(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column as a matrix, and the positions of the rows that have one.

    Vectors of different dimensions, or of others than ``width``, are an error.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    valid = np.flatnonzero(~np.asarray(vectors.is_null()))
    if not len(valid):
        return np.zeros((0, 0)), valid
    dense = vectors.take(pa.array(valid))
    sizes = np.unique(np.asarray(dense.value_lengths()))
    if len(sizes) > 1 or width is not None and sizes[0] != width:
        raise ValueError(f"vectors of {sizes.tolist()} dimensions where {width or int(sizes[0])} are wanted")
    flat = dense.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(valid), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms), valid


def best_rows(similarity: np.ndarray, doc_ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, document) positions of the ``n`` best documents of each query, ties by doc_id.

    ``similarity`` is queries x documents. Everything tied with the n-th best score is kept before
    the exact order is settled, so no tie is lost.
    """
    if similarity.shape[1] <= n:
        q, d = np.indices(similarity.shape).reshape(2, -1)
        return q, d
    rounded = np.round(similarity, 9)
    kth = np.partition(rounded, -n, axis=1)[:, -n][:, None]
    q, d = np.nonzero(rounded >= kth)
    order = np.lexsort((doc_ids[d], -rounded[q, d], q))
    q, d = q[order], d[order]
    starts = np.searchsorted(q, np.arange(similarity.shape[0]))
    keep = np.arange(len(q)) - starts[q] < n
    return q[keep], d[keep]


def _scored(batch_ids: pa.Array, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
            n: int) -> Iterator[pa.RecordBatch]:
    doc_ids = np.asarray(batch_ids.to_pylist(), dtype=object)
    step = max(1, PRODUCT_CELLS // max(len(doc_ids), 1))
    for start in range(0, len(query_ids), step):
        block = queries[start:start + step]
        similarity = 1 - (1 - block @ matrix.T) / 2
        q, d = best_rows(similarity, doc_ids, n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[start:start + step][q], pa.int64()),
             pa.array(doc_ids[d], pa.string()),
             pa.array(similarity[q, d], pa.float64())],
            names=["query_id", "doc_id", "score"])


def _scan_with_matrix(queries: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    table = queries.toArrow()  # measured before: at most MATRIX_BYTES
    matrix, valid = unit_rows(table.column("query_vec"))
    ids = np.asarray(table.column("query_id"))[valid]
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = shared.value
        for batch in batches:
            docs, rows = unit_rows(batch.column(1), query_matrix.shape[1] if len(query_ids) else None)
            if len(rows) and len(query_ids):
                yield from _scored(batch.column(0).take(pa.array(rows)), docs, query_ids, query_matrix, n)

    return corpus.select("doc_id", "embedding").mapInArrow(scan, HIT_SCHEMA)


def vector_topk(queries: DataFrame, corpus: DataFrame, n: int, matrix_bytes: int | None = None,
                measured: tuple[int, int] | None = None) -> DataFrame:
    """Best ``n`` documents per query by cosine similarity in [0, 1], ties by doc_id.

    Queries beyond ``matrix_bytes`` come in chunks of that size; each chunk reads the corpus where it
    lies, and no corpus row is copied or shuffled.

    A query without a vector has no hits; a document without a vector is never one. ``measured``
    (rows, bytes) of the queries saves measuring them again.
    """
    asked = queries.filter(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    having = corpus.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding")
    size = (measured or measure(asked))[1]
    chunks = max(1, math.ceil(size / (MATRIX_BYTES if matrix_bytes is None else matrix_bytes)))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks))
    hits = reduce(DataFrame.unionByName, [
        _scan_with_matrix(asked.filter(chunk == i) if chunks > 1 else asked, having, n) for i in range(chunks)])
    order = [scores.order_score(F.col("score")).desc(), F.col("doc_id")]
    return top_per_group(hits, ["query_id"], order, n, ["doc_id"])


def vector_search(queries: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """Pure vector search without fusion."""
    return vector_topk(queries, corpus, k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that another search found: queries, found, expected, recall."""
    marks = approximate.select("query_id", "doc_id", F.lit(1).alias("hit"))
    joined = exact.select("query_id", "doc_id").join(marks, ["query_id", "doc_id"], "left")
    return joined.agg(F.count_distinct("query_id").alias("queries"), F.count("hit").alias("found"),
                      F.count(F.lit(1)).alias("expected"),
                      (F.count("hit") / F.count(F.lit(1))).alias("recall"))
