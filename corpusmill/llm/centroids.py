"""Centroid clustering by equal-average equal-variance nearest-centroid search, in exact integers.

With k components, S their sum and V the root of k * (sum of squares) - S * S, two vectors obey
k * distance >= (S - S')^2 + (V - V')^2 (squared Euclidean distance; Lee and Chen 1994). Centroids are
sorted by S, hence by mean. A vector's search starts beside its own S and goes outward on both sides,
the nearer side first. Once (S - S')^2 alone exceeds k times the best distance so far, no centroid
further out can win and the search ends; a centroid that fails the inequality with both terms is
passed over; the others are measured in whole numbers. A bound must exceed the best distance
strictly, so ties are always measured.

All vectors of a batch search together, one step each at a time. A round sends the centroids with the
tasks, which return one partial sum per centroid; nothing else leaves a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import stored

# Whole numbers up to this size: all sums and products of a search are exact in doubles.
NARROW = 1 << 18
# Rows of a batch that search together.
ROWS = 4096
# Sums beyond a long travel in pieces of so many bits.
PIECE = 40
LONGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding",
                  scale: int = 256) -> DataFrame:
    """``vec_id, v`` of the vectors with ``dims`` components, none null or non-finite; v holds floor(scale * x).

    v stays an array of doubles, whose values are whole, so that no component is too large for it; a vector
    whose scaled component is beyond a double takes no part.
    """
    x = F.col(vec_col)
    scaled = F.transform(x, lambda c: c.cast("double") * scale)
    finite = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    floors = F.transform(scaled, lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c))
    return vectors.filter(x.isNotNull() & (F.size(x) == dims) & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), floors.alias("v"))


class Centroids:
    """Centroids in order of their component sums."""

    def __init__(self, centres: list[list[int]]):
        self.dims = len(centres[0])
        rows = sorted((sum(c), i) for i, c in enumerate(centres))
        self.number = np.array([i for _, i in rows], np.int64)
        self.whole = [centres[i] for _, i in rows]
        self.sums = [s for s, _ in rows]
        self.spread = [self.dims * sum(x * x for x in c) - s * s for c, (s, _) in zip(self.whole, rows)]
        self.narrow = max(abs(x) for c in centres for x in c) <= NARROW
        if self.narrow:
            self.values = np.array(self.whole, np.float64)
            self.sum = np.array(self.sums, np.float64)
            self.deviation = np.sqrt(np.array(self.spread, np.float64))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, list[int], int]:
        """Number and squared distance of each row's nearest centroid, and how many distances were measured."""
        wide = np.abs(v).max(axis=1, initial=0) > NARROW if self.narrow else np.ones(len(v), bool)
        number, distance = np.zeros(len(v), np.int64), [0] * len(v)
        near, best, measured = self._nearest(v[~wide])
        number[~wide] = near
        for i, d in zip(np.flatnonzero(~wide), best.astype(np.int64).tolist()):
            distance[i] = d
        for i in np.flatnonzero(wide):
            number[i], distance[i], n = self._nearest_wide([int(x) for x in v[i]])
            measured += n
        return number, distance, measured

    def _nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, m, k = len(v), len(self.number), self.dims
        best, found, measured = np.full(n, np.inf), np.full(n, m, np.int64), 0
        if not n:
            return found, best, measured
        total = v.sum(axis=1)
        deviation = np.sqrt(np.maximum(k * (v * v).sum(axis=1) - total * total, 0))
        sums = np.concatenate([[-np.inf], self.sum, [np.inf]])  # places 1 to m
        below = np.searchsorted(self.sum, total)
        above = below + 1
        live = np.arange(n)
        while len(live):
            left, right = total[live] - sums[below], sums[above] - total[live]
            down = left <= right
            gap = np.where(down, left, right) ** 2
            on = np.flatnonzero(np.isfinite(gap) & (gap <= k * best[live]))
            live, down, gap = live[on], down[on], gap[on]
            below, above = below[on], above[on]
            place = np.where(down, below, above) - 1
            bound = gap + (deviation[live] - self.deviation[place]) ** 2
            keep = np.flatnonzero(bound <= k * best[live] + 1)  # rounding never rejects
            rows, at = live[keep], place[keep]
            d = ((v[rows] - self.values[at]) ** 2).sum(axis=1)
            measured += len(rows)
            wins = (d < best[rows]) | (d == best[rows]) & (self.number[at] < found[rows])
            best[rows[wins]], found[rows[wins]] = d[wins], self.number[at[wins]]
            below, above = below - down, above + ~down
        return found, best, measured

    def _nearest_wide(self, v: list[int]) -> tuple[int, int, int]:
        """The same search in Python's integers, for components of any size."""
        m, k, total = len(self.number), self.dims, sum(v)
        spread = k * sum(x * x for x in v) - total * total
        above = next((i for i, s in enumerate(self.sums) if s >= total), m)
        below, best, found, measured = above - 1, None, m, 0
        while below >= 0 or above < m:
            if above >= m or below >= 0 and total - self.sums[below] <= self.sums[above] - total:
                at, below = below, below - 1
            else:
                at, above = above, above + 1
            gap = (total - self.sums[at]) ** 2
            if best is not None and gap > k * best:
                break
            # (V - V')^2 rounded down
            apart = spread + self.spread[at] - 2 * (math.isqrt(spread * self.spread[at]) + 1)
            if best is not None and gap + max(apart, 0) > k * best:
                continue
            d = sum((a - b) ** 2 for a, b in zip(v, self.whole[at]))
            measured += 1
            if best is None or (d, self.number[at]) < (best, found):
                best, found = d, int(self.number[at])
        return found, best, measured


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pieces(total: int) -> list[int]:
    """A whole number as pieces of PIECE bits, lowest first; all but the last are not negative."""
    out = []
    while not -(1 << 62) < total < 1 << 62:
        out.append(total & ((1 << PIECE) - 1))
        total >>= PIECE
    return [*out, total]


def _moved(vectors: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the floored mean of the vectors nearest to it; one without vectors stays."""
    known = Centroids(centres)
    m, k = len(centres), known.dims
    schema = pa.schema([("cluster", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()),
                        ("sums", pa.list_(pa.int64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(m, np.int64), np.zeros((m, k), object)
        for _, v in _matrices(batches, k):
            number, *_ = known.nearest(v)
            counts += np.bincount(number, minlength=m)
            order = np.argsort(number, kind="stable")
            cuts = np.flatnonzero(np.diff(number[order], prepend=-1))
            ordered = v[order]
            if np.abs(v).max(initial=0) <= NARROW:
                part = np.add.reduceat(ordered, cuts, axis=0).astype(np.int64).astype(object)
            else:
                whole = np.array([[int(x) for x in row] for row in ordered], object)
                part = np.add.reduceat(whole, cuts, axis=0)
            sums[number[order][cuts]] += part
        rows = []
        for c in np.flatnonzero(counts).tolist():
            cells = [_pieces(int(x)) for x in sums[c]]
            for piece in range(max(map(len, cells))):
                rows.append((c, piece, int(counts[c]) if not piece else 0,
                             [cell[piece] if piece < len(cell) else 0 for cell in cells]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)],
                                         schema=schema)

    parts = vectors.select("v").mapInArrow(add, "cluster long, piece long, n long, sums array<long>")
    totals = parts.select("cluster", "piece", "n", F.posexplode("sums")).groupBy("cluster", "piece", "pos").agg(
        F.sum("n").alias("n"), F.sum("col").alias("total"))
    counts, sums = [0] * m, [[0] * k for _ in range(m)]
    for r in totals.collect():  # one row per component of a centroid
        sums[r["cluster"]][r["pos"]] += r["total"] << (PIECE * r["piece"])
        counts[r["cluster"]] = max(counts[r["cluster"]], r["n"])
    return [[x // n for x in row] if n else old for n, row, old in zip(counts, sums, centres)]


def cluster_vectors(vectors: DataFrame, n_centroids: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2",
                    id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Cluster ``vectors``: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector kept.

    Kept are vectors of ``dims`` components, none null or non-finite, as floor(scale * x). Centroids start as
    the ``n_centroids`` vectors with the smallest SHA-256 of ``seed:vec_id``. Each round assigns every vector to
    its nearest centroid, ties to the smaller number, and replaces every centroid that has vectors by their
    floored mean. Then vectors are assigned once more.

    ``distance`` is squared; it and its sums ``cluster_inertia`` and ``inertia`` stop at the largest long.
    Null ids take part and come last as starting centroids. Vectors that share an id start in the order of
    their components. Repeated rows count each. With fewer vectors than centroids each vector starts one. An
    empty table, or one without such vectors, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    kept = stored(whole_vectors(vectors, dims, id_col, vec_col, scale), "whole-vectors")
    start = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v")
    centres = [[int(x) for x in r["v"]] for r in start.limit(n_centroids).collect()]
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not centres:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centres = _moved(kept, centres)
    known = Centroids(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _matrices(batches, dims):
            number, distance, _ = known.nearest(v)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(number, pa.int32()),
                 pa.array([min(d, LONGEST) for d in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = stored(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}  # one row per centroid
    whole = min(sum(sums.values()), LONGEST)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    about = spark.createDataFrame([(c, min(s, LONGEST), whole, digests[c]) for c, s in sums.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(*[f.split()[0] for f in schema.split(", ")])
