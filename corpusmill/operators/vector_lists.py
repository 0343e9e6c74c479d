"""Inverted file of vectors: lists around trained centroids, codes with error bounds, exact results.

Every vector lies in the list of its nearest centroid with its angle to it, and as a code of one byte per
component with the length of what the code leaves out. For a unit query, the angles bound every
similarity in a list, and the code bounds the vector's own to a few thousandths:

1. The lists nearest to a query, so many that they hold a few times ``n`` vectors, are read first. Their n-th
   highest lower bound is a similarity that a hit must reach.
2. Lists that cannot reach it by their angles are not read. Of the others, in order of nothing but where
   they lie, codes whose upper bound falls short stay out; each task raises the bar as it goes.
3. What is left, little more than ``n`` per query, is joined with the vectors and scored exactly.

So the hits are those of a scan of all vectors. How many lists are read depends on the vectors: few if
they are clustered, most if they are spread evenly. Reading codes takes a quarter of reading vectors, and
vectors are read for the last few candidates only. With ``most_lists`` a search reads only each query's
nearest lists and is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import scores
from corpusmill.operators.vector import HIT_SCHEMA, MATRIX_BYTES, PRODUCT_CELLS, unit_rows
from corpusmill.runtime import lookup_join, measure, stored, top_per_group

# Centroids are trained on at most so many vectors, the first by a hash of their id; every vector is then listed.
TRAINING_ROWS = 20_000
TRAINING_ROUNDS = 10
MOST_CENTROIDS = 4096
# Rounding never rejects a hit; scores are ranked by nine places.
SLACK = 1e-7
# The first lists of a query hold so many times n vectors.
FIRST_READ = 8
CODES = "list int, doc_id string, angle double, scale double, error double, code binary"


@dataclass(frozen=True)
class VectorLists:
    """``codes`` of all vectors by list, and the vectors themselves, held once."""

    centroids: np.ndarray  # one unit row per list
    codes: DataFrame       # CODES (and part, if stored)
    vectors: DataFrame     # doc_id, embedding
    parts: int | None = None  # number of folders that lists are dealt to, if stored


def train_centroids(vectors: DataFrame, lists: int | None = None, sample: int = TRAINING_ROWS,
                    rounds: int = TRAINING_ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means on a sample of bounded size.

    ``lists`` defaults to the square root of the number of vectors. No vectors give no centroids.
    """
    having = vectors.filter(F.col("embedding").isNotNull())
    n = having.count()
    wanted = min(lists or math.isqrt(max(n - 1, 0)) + 1, MOST_CENTROIDS)
    chosen = having.orderBy(F.xxhash64("doc_id"), "doc_id").select("embedding").limit(sample).toArrow()
    rows, _ = unit_rows(chosen.column("embedding"))
    if not len(rows):
        return np.zeros((0, 0))
    centres = np.unique(rows, axis=0) if wanted >= len(rows) else rows[:wanted].copy()
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths == 0, 1.0, lengths), centres)
    return centres


def _angles(products: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(products, -1.0, 1.0))


def vector_codes(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """List, angle and code of every vector; no shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CENTROIDS rows
    names = [f.split()[0] for f in CODES.split(", ")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            rows, valid = unit_rows(batch.column(1), centres.shape[1] if len(centres) else None)
            if not len(valid):
                continue
            products = rows @ centres.T
            nearest = products.argmax(axis=1)
            scale = np.abs(rows).max(axis=1) / 127
            codes = np.rint(rows / np.where(scale == 0, 1.0, scale)[:, None]).astype(np.int8)
            error = np.linalg.norm(rows - codes * scale[:, None], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nearest, pa.int32()), batch.column(0).take(pa.array(valid)),
                 pa.array(_angles(products[np.arange(len(rows)), nearest])), pa.array(scale), pa.array(error),
                 pa.array([c.tobytes() for c in codes], pa.binary())], names)

    return vectors.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding").mapInArrow(code, CODES)


def write_codes(codes: DataFrame, path: str, parts: int) -> None:
    """Folders of lists, files sorted by list and angle; rows of one list may span files and tasks."""
    dealt = codes.withColumn("part", F.pmod(F.col("list"), F.lit(parts)))
    order = ["part", "list", "angle", "doc_id"]
    dealt.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("part").parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CODES}, part int").parquet(path)


def vector_lists(vectors: DataFrame, lists: int | None = None) -> VectorLists:
    """Lists of a corpus as plans, nothing stored."""
    having = vectors.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding")
    centroids = train_centroids(having, lists)
    return VectorLists(centroids, vector_codes(having, centroids), having)


def save_vector_lists(vectors: DataFrame, path: str, lists: int | None = None, parts: int = 256) -> VectorLists:
    """Store the codes, so that searches read those of the lists they need."""
    built = vector_lists(vectors, lists)
    write_codes(built.codes, path, parts)
    return VectorLists(built.centroids, read_codes(vectors.sparkSession, path), built.vectors, parts)


# --- search ---------------------------------------------------------------------------------------


class _Queries:
    """A chunk of queries of bounded size, sent to the tasks."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, allowed: np.ndarray, bar: np.ndarray):
        self.ids, self.rows, self.allowed, self.bar = ids, rows, allowed, bar


def _decoded(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8)
    return flat.reshape(batch.num_rows, width) * batch.column("scale").to_numpy()[:, None]


def _bounds(batches: Iterator[pa.RecordBatch], queries: _Queries, n: int
            ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per batch and list: places of queries and rows whose upper bound reaches the query's bar, both bounds.

    The bar of a query is at least the n-th highest lower bound that this task has met.
    """
    best = np.full((len(queries.ids), n), -np.inf)
    best[:, 0] = -np.inf
    bar = queries.bar.copy()
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors, error = _decoded(batch, queries.rows.shape[1]), batch.column("error").to_numpy() + SLACK
        listed = batch.column("list").to_numpy()
        for number in np.unique(listed):
            asked = np.flatnonzero(queries.allowed[:, number])
            mine = np.flatnonzero(listed == number)
            step = max(1, PRODUCT_CELLS // len(mine))
            for a in range(0, len(asked), step):
                some = asked[a:a + step]
                near = queries.rows[some] @ vectors[mine].T
                low = near - error[mine]
                kept = np.concatenate([best[some], low], axis=1)
                best[some] = np.partition(kept, -n, axis=1)[:, -n:]
                bar[some] = np.maximum(bar[some], best[some].min(axis=1))
                q, d = np.nonzero(near + error[mine] >= bar[some][:, None])
                yield batch, some[q], mine[d], low[q, d], near[q, d] + error[mine[d]]


def _list_bounds(lists: VectorLists, n: int, queries: np.ndarray, most_lists: int | None
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Highest similarity each list can hold for each query, and the lists that each query reads first."""
    count = len(lists.centroids)
    spans = lists.codes.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"),
                                            F.max("angle").alias("high")).collect()  # one row per list
    rows, low, high = np.zeros(count, np.int64), np.full(count, np.inf), np.full(count, -np.inf)
    for r in spans:
        rows[r["list"]], low[r["list"]], high[r["list"]] = r["n"], r["low"], r["high"]
    angle = _angles(queries @ lists.centroids.T)
    gap = np.maximum(np.maximum(angle - high, low - angle), 0.0)
    reach = np.where(rows > 0, np.cos(np.minimum(gap, math.pi)) + SLACK, -np.inf)
    order = np.argsort(np.where(rows > 0, angle, np.inf), axis=1, kind="stable")
    before = np.cumsum(rows[order], axis=1) - rows[order]
    first = np.zeros(angle.shape, bool)
    if most_lists is not None:
        np.put_along_axis(first, order[:, :most_lists], True, axis=1)
        return np.where(first, reach, -np.inf), first
    np.put_along_axis(first, order, before < FIRST_READ * n, axis=1)
    return reach, first & (rows > 0)


def _in_lists(lists: VectorLists, wanted: np.ndarray) -> DataFrame:
    """Codes of the lists that some query reads; their folders and row groups are all that is read."""
    numbers = np.flatnonzero(wanted.any(axis=0)).tolist()
    codes = lists.codes
    if len(numbers) < len(lists.centroids):
        if lists.parts is not None:
            codes = codes.filter(F.col("part").isin(sorted({x % lists.parts for x in numbers})))
        codes = codes.filter(F.col("list").isin(numbers))
    return codes.select(*[f.split()[0] for f in CODES.split(", ")])


def _candidates(asked: DataFrame, lists: VectorLists, n: int, most_lists: int | None) -> DataFrame:
    """``query_id, doc_id, low, high`` of one chunk of queries."""
    spark = asked.sparkSession
    schema = "query_id long, doc_id string, low double, high double"
    table = asked.toArrow()  # at most MATRIX_BYTES
    rows, valid = unit_rows(table.column("query_vec"), lists.centroids.shape[1] if len(lists.centroids) else None)
    if not len(valid) or not len(lists.centroids):
        return spark.createDataFrame([], schema)
    ids = np.asarray(table.column("query_id"))[valid]
    reach, first = _list_bounds(lists, n, rows, most_lists)

    def shared(allowed: np.ndarray, bar: np.ndarray):
        return spark.sparkContext.broadcast(_Queries(ids, rows, allowed, bar))

    opening = shared(first, np.full(len(ids), -np.inf))

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, _, low, _ in _bounds(batches, opening.value, n):
            yield pa.RecordBatch.from_arrays([pa.array(opening.value.ids[q]), pa.array(low)], ["query_id", "low"])

    lows = _in_lists(lists, first).mapInArrow(bars, "query_id long, low double")
    kth = top_per_group(lows, ["query_id"], [F.col("low").desc()], n, ["low"]).groupBy("query_id").agg(
        F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)
    known = {r["query_id"]: r["low"] for r in kth.collect()}  # one row per query of the chunk
    bar = np.array([known.get(i, -np.inf) for i in ids.tolist()])
    allowed = reach >= bar[:, None]
    allowed &= reach > -np.inf
    main = shared(allowed, bar)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, q, d, low, high in _bounds(batches, main.value, n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(main.value.ids[q]), batch.column("doc_id").take(pa.array(d)), pa.array(low), pa.array(high)],
                ["query_id", "doc_id", "low", "high"])

    return _in_lists(lists, allowed).mapInArrow(survivors, schema)


def candidates(queries: DataFrame, lists: VectorLists, n: int, most_lists: int | None = None) -> DataFrame:
    """``query_id, doc_id``: all documents that can be among the best ``n`` of a query as far as codes tell."""
    asked = queries.filter(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    chunks = max(1, math.ceil(measure(asked)[1] / MATRIX_BYTES))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks))
    found = stored(reduce(DataFrame.unionByName, [
        _candidates(asked.filter(chunk == i) if chunks > 1 else asked, lists, n, most_lists) for i in range(chunks)]),
        "vector-candidates")
    kth = (top_per_group(found.select("query_id", "low"), ["query_id"], [F.col("low").desc()], n, ["low"])
           .groupBy("query_id").agg(F.min("low").alias("bar"), F.count(F.lit(1)).alias("m")))
    bar = kth.select("query_id", F.when(F.col("m") >= n, F.col("bar")).otherwise(-2.0).alias("bar"))
    kept = lookup_join(found, bar, ["query_id"], spread=["doc_id"])
    return stored(kept.filter(F.col("high") >= F.col("bar")).select("query_id", "doc_id"), "vector-survivors")


def _exact(wanted: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact scores of candidate pairs, in Arrow batches."""
    pairs = lookup_join(vectors, wanted, ["doc_id"]).select("query_id", "doc_id", "embedding")
    asked = queries.filter(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    both = lookup_join(pairs, asked, ["query_id"], spread=["doc_id"]).select("query_id", "doc_id", "embedding", "query_vec")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                docs, _ = unit_rows(batch.column("embedding"))
                asks, _ = unit_rows(batch.column("query_vec"), docs.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("doc_id"),
                     pa.array(1 - (1 - np.einsum("ij,ij->i", asks, docs)) / 2)], ["query_id", "doc_id", "score"])

    return both.mapInArrow(score, HIT_SCHEMA)


def search_lists(queries: DataFrame, lists: VectorLists, n: int, most_lists: int | None = None) -> DataFrame:
    """Best ``n`` documents per query by cosine similarity in [0, 1], ties by doc_id: as ``vector_topk``, by lists.

    With ``most_lists`` only that many lists per query are read, the nearest, and hits elsewhere are missed. A
    query without a vector has no hits; a document without a vector is never one. Without documents there
    are no hits. Vectors of different dimensions are an error.
    """
    found = _exact(candidates(queries, lists, n, most_lists), queries, lists.vectors)
    order = [scores.order_score(F.col("score")).desc(), F.col("doc_id")]
    return top_per_group(found, ["query_id"], order, n, ["doc_id"])
