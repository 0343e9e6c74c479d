"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets, so a bucket holds vectors of similar length
(Teflioudi et al. 2015). A query's best scores so far, first from the longest vectors of all, give the
least score it still needs. Divided by its own and the bucket's largest length that is the cosine it
needs in the bucket. Above 1 the bucket is skipped. If it is high, vectors are pruned by the range
that their value in the query's largest coordinate must lie in; if it is low, by length alone. What is
left is verified with exact products.

Queries come in chunks of bounded size, which are copied to the tasks; each chunk reads the sorted
vectors where they are. Only scores that may still count leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.runtime import stored

QUERY_CELLS = 2 << 20
BUCKET = 2048
SEEDS = 1024
HIGH_COSINE = 0.8
# Sums of doubles are exact and leave room for a place in the bucket below this size.
EXACT = float(1 << 50)
LOWEST = np.iinfo(np.int64).min + 1  # its negative is a long too


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    scale: int = 256) -> DataFrame:
    """``row, vec_id, v, length``: components as floor(scale * x), rows that can't take part left out."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return (vectors.filter(x.isNotNull() & F.col(id_col).isNotNull() & finite)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                    whole.alias("v"))
            .withColumn("length", F.sqrt(squares)))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of all rows; beyond 64 bits they stop at the largest long."""
    if bound < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < float(1 << 62):
        return a @ b.T
    big = a.astype(object) @ b.T.astype(object)
    return np.array([[min(max(x, LOWEST + 1), -LOWEST) for x in line] for line in big], np.int64).reshape(big.shape)


def _best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best columns of each line by score, then smaller id."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (scores, ids, places))


class Chunk:
    """A chunk of queries with their best scores so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
        self.rows, self.ids, self.v, self.k = rows, ids, v, k
        self.length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        self.needed = np.full(len(rows), float("-inf"))
        self.clear()

    def clear(self) -> None:
        shape = (len(self.rows), self.k)
        self.score = np.full(shape, LOWEST)
        self.found = np.full(shape, np.iinfo(np.int64).max)
        self.place = np.full(shape, -1)

    def take(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge candidate columns into the best of the chosen queries."""
        scores = np.where(rows[None, :] == self.rows[which, None], LOWEST, scores)
        if scores.shape[1] > self.k:
            # columns come by id, so a column's place breaks ties; only the k best need sorting
            if np.abs(scores[scores != LOWEST]).max(initial=0) < EXACT:
                wide = np.where(scores == LOWEST, LOWEST, scores * BUCKET - np.arange(scores.shape[1]))
                part = np.argpartition(wide, -self.k, axis=1)[:, -self.k:]
            else:
                part = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=-1)[:, :self.k]
        else:
            part = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        merged = [np.concatenate([old[which], new], axis=1) for old, new in (
            (self.score, np.take_along_axis(scores, part, axis=1)), (self.found, ids[part]), (self.place, rows[part]))]
        self.score[which], self.found[which], self.place[which] = _best(*merged, self.k)

    def least(self) -> np.ndarray:
        """The score a candidate must reach to count for each query."""
        kth = self.score[:, -1]
        return np.maximum(self.needed, np.where(kth == LOWEST, -np.inf, kth.astype(np.float64)))

    def search(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, high: float = HIGH_COSINE) -> None:
        """Look through one bucket of at most BUCKET vectors."""
        length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        ids, rows, v, length = ids[order], rows[order], v[order], length[order]
        top = float(length[0])
        need = self.least()
        need = need - np.abs(np.where(np.isfinite(need), need, 0)) * 1e-9 - 1e-6  # rounding never prunes
        reach = self.length * top
        live = np.flatnonzero(reach >= need)
        if not len(live):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach[live] > 0, need[live] / reach[live], -1.0)
            shortest = np.where((need[live] > 0) & (self.length[live] > 0), need[live] / self.length[live], 0.0)
        prefix = np.searchsorted(-length, -shortest, side="right")
        by_value = cosine >= high
        unit = None
        for i in np.flatnonzero(by_value):
            if unit is None:
                unit = v / np.where(length == 0, 1.0, length)[:, None]
            q = live[i]
            f = int(np.argmax(np.abs(self.v[q])))
            angle, spread = np.arccos(np.clip(self.v[q, f] / self.length[q], -1, 1)), np.arccos(min(cosine[i], 1.0))
            low, up = np.cos(min(np.pi, angle + spread)) - 1e-9, np.cos(max(0.0, angle - spread)) + 1e-9
            near = np.flatnonzero((unit[:prefix[i], f] >= low) & (unit[:prefix[i], f] <= up))
            if len(near):
                self._verify(np.array([q]), near, ids, rows, v, top)
        rest, ends = live[~by_value], prefix[~by_value]
        step = max(QUERY_CELLS // BUCKET, 1)
        order = np.argsort(ends, kind="stable")
        for a in range(0, len(rest), step):
            group = order[a:a + step]
            end = int(ends[group].max(initial=0))
            if end:
                self._verify(rest[group], np.arange(end), ids, rows, v, top)

    def _verify(self, which, near, ids, rows, v, top) -> None:
        near = near[np.argsort(ids[near], kind="stable")]
        scores = _products(self.v[which], v[near], float(self.length[which].max()) * top)
        self.take(which, scores, ids[near], rows[near])


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, seeds: int = SEEDS,
                 query_cells: int = QUERY_CELLS) -> DataFrame:
    """Each query's ``k`` highest inner products: ``query_id, rank, vec_id, score``.

    Both inputs come from ``integer_vectors``; a candidate with the query's ``row`` is left out, and
    equal scores go by smaller ``vec_id``. With fewer candidates than ``k`` all are returned. Vectors
    of different size are compared as if the shorter ended in zeros. Repeated rows are candidates
    each, and repeated queries are answered each. Empty tables give no rows. Scores beyond a long
    stop there.
    """
    spark = vectors.sparkSession
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    out_schema = "query_row long, query_id long, vec_id long, row long, score long"
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(size["width"], vectors.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    chunks = -(-size["n"] * width // query_cells)
    # a bounded number of rows
    longest = vectors.orderBy(F.col("length").desc(), "row").limit(seeds).collect()
    parts = []
    for c in range(chunks):
        mine = queries.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c).select("row", "vec_id", "v").collect()
        if not mine:
            continue
        chunk = Chunk(np.array([r["row"] for r in mine]), np.array([r["vec_id"] for r in mine]),
                      _matrix([r["v"] for r in mine], width), k)
        for a in range(0, len(longest), BUCKET):
            seed = longest[a:a + BUCKET]
            chunk.search(np.array([r["vec_id"] for r in seed]), np.array([r["row"] for r in seed]),
                         _matrix([r["v"] for r in seed], width))
        chunk.needed = chunk.least()
        chunk.clear()
        parts.append(vectors.select("row", "vec_id", "v").mapInArrow(_scan(spark, chunk, width), out_schema))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _scan(spark, chunk: Chunk, width: int):
    shared = spark.sparkContext.broadcast(chunk)  # at most QUERY_CELLS numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Chunk = shared.value
        mine.clear()
        for batch in batches:
            for a in range(0, batch.num_rows, BUCKET):
                part = batch.slice(a, BUCKET)
                mine.search(part.column("vec_id").to_numpy(), part.column("row").to_numpy(),
                            _matrix(part.column("v").to_pylist(), width))
        q, j = np.nonzero((mine.score != LOWEST) & (mine.score >= mine.needed[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (mine.rows[q], mine.ids[q], mine.found[q, j], mine.place[q, j], mine.score[q, j])],
            ["query_row", "query_id", "vec_id", "row", "score"])
        mine.clear()

    return scan


def sorted_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Integer vectors written in order of length, longest first, so that files are length buckets."""
    whole = stored(integer_vectors(vectors, id_col, vec_col), "vectors")  # fixes the row numbers
    order = [F.col("length").desc(), F.col("row")]
    return stored(whole.repartitionByRange(*order).sortWithinPartitions(*order), "sorted-vectors")
