"""Document fingerprints by one-permutation MinHash with optimal densification.

A text's word n-grams are hashed once. The leading bits of a hash choose one of ``bins`` bins and
the smallest rest per bin is kept. An empty bin takes the value of a bin that was filled, drawn by a
fixed sequence of random bins of its own (Shrivastava 2017). Only the lowest ``bits`` bits of each
bin are stored, packed; the share of equal bins, corrected for chance agreement 2^-bits, estimates
the Jaccard similarity of the n-gram sets (Li and Koenig 2010).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.words import SLICE_BYTES, WordTable, mix, shingles, texts_of, word_hashes


class Fingerprinter:
    """Packed fingerprints of texts. A text without words has the empty fingerprint."""

    def __init__(self, bins: int = 512, bits: int = 4, n: int = 5):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8")
        self.bins, self.bits, self.n = bins, bits, n
        self._words = WordTable(word_hashes)

    def _drawn(self, bin_: np.ndarray, attempt: int) -> np.ndarray:
        """The bin that an empty bin asks at an attempt."""
        return (mix(bin_.astype(np.uint64) * np.uint64(0x100000001) + np.uint64(attempt))
                % np.uint64(self.bins)).astype(np.int64)

    def values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Densified bin minima as a matrix, and whether a text has any words."""
        hashes, counts = shingles(*self._words(texts), self.n)
        shift = np.uint64(self.bins.bit_length() - 1)
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        least = np.full(len(texts) * self.bins, none, np.uint64)
        cell = np.repeat(np.arange(len(texts)) * self.bins, counts)
        if shift:
            cell = cell + (hashes >> (np.uint64(64) - shift)).astype(np.int64)
        np.minimum.at(least, cell, hashes << shift >> shift)
        least = least.reshape(len(texts), self.bins)
        filled = least != none
        number = filled.sum(axis=1)
        one = np.flatnonzero(number == 1)  # whatever is drawn, there is one value to take
        least[one] = least[one].min(axis=1, keepdims=True)
        row, bin_ = np.nonzero(~filled & (number > 1)[:, None])
        attempt = 0
        while len(row):
            asked = self._drawn(bin_, attempt)
            ready = filled[row, asked]
            least[row[ready], bin_[ready]] = least[row[ready], asked[ready]]
            row, bin_ = row[~ready], bin_[~ready]
            attempt += 1
        return least, number > 0

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        least, some = self.values(texts)
        low = (least & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        planes = (low[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & 1
        packed = np.packbits(planes.reshape(len(texts), -1), axis=1)
        return [p.tobytes() if s else b"" for p, s in zip(packed, some)]

    def likeness(self, a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Estimated Jaccard similarity of pairs of fingerprints, 0 to 1.

        Two empty fingerprints are alike (1); an empty and another one are not (0).
        """
        result = np.array([float(not x and not y) for x, y in zip(a, b)])
        both = [i for i, (x, y) in enumerate(zip(a, b)) if x and y]
        if both:
            bits = [np.unpackbits(np.frombuffer(b"".join(s[i] for i in both), np.uint8)).reshape(
                len(both), self.bins, self.bits) for s in (a, b)]
            equal = (bits[0] == bits[1]).all(axis=2).mean(axis=1)
            chance = 2.0 ** -self.bits
            result[both] = np.clip((equal - chance) / (1 - chance), 0, 1)
        return result


def fingerprint_documents(docs: DataFrame, bins: int = 512, bits: int = 4, n: int = 5, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (packed bytes, empty for a text without words) of every whole text.

    Null and empty texts have the empty fingerprint; equal texts have equal ones; repeated rows get one
    each; a text of fewer than n words is one n-gram. No shuffle.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(bins, bits, n)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            out: list[bytes] = []
            for part in _runs(texts, SLICE_BYTES):
                out += prints(part)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())],
                                             ["doc_id", "fingerprint"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(sign, "doc_id long, fingerprint binary")


def _runs(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def with_next(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``range, guest, doc_id, text`` in tasks sorted by descending id, each followed by the next.

    Ids are cut into ``ranges`` ranges (four per shuffle partition by default) at approximate quantiles.
    Each range also gets the first row of the range after it as a guest, and the last one the first of
    all, so a row's next row is always in its own range. Texts are shuffled once; the ranges' first
    rows, one per range, pass through the driver as ids and hashes. Equal ids are ordered by text
    hash; null ids come last.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * parts
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.xxhash64(text_col).alias("mark"))
    shares = [i / ranges for i in range(1, ranges)]
    ids = source.select(F.col("doc_id").cast("double").alias("id"))
    bounds = np.unique(np.array(ids.approxQuantile("id", shares, 0.25 / ranges) if shares else [], np.float64))

    @F.arrow_udf(T.IntegerType())
    def range_of(column: pa.Array) -> pa.Array:
        values = np.asarray(column.cast(pa.float64(), safe=False).fill_null(-np.inf))
        place = len(bounds) - np.searchsorted(bounds, values, side="right")
        missing = np.asarray(column.is_null())
        return pa.array(np.where(missing, len(bounds), place).astype(np.int32))

    ranged = source.withColumn("range", range_of("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("back"), "mark"))
    heads = sorted((r["range"], None if r["first"]["none"] else -r["first"]["back"], r["first"]["mark"])
                   for r in ranged.drop("text").groupBy("range").agg(first.alias("first")).collect())
    guests = [(doc, mark, heads[i - 1][0]) for i, (_, doc, mark) in enumerate(heads)]
    # one row per range, a number the caller sets
    invited = F.broadcast(spark.createDataFrame(guests, "id long, at long, host int"))
    joined = ranged.join(invited, ranged["doc_id"].eqNullSafe(F.col("id")) & (F.col("mark") == F.col("at")), "left")
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    away = F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("range"), F.lit(1).alias("guest")))
    sent = joined.select("doc_id", "text", "mark", F.explode(F.array_compact(F.array(own, away))).alias("to"))
    return (sent.select("to.range", "to.guest", "doc_id", "text", "mark").repartition(parts, "range")
            .sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "mark")
            .select("range", "guest", "doc_id", "text"))


def edited_fingerprints(docs: DataFrame, bins: int = 512, bits: int = 4, n: int = 5, id_col: str = "doc_id",
                        text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document's in descending id; the first document follows the last. Returns ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint`` (hexadecimal), ``near_edited, near_next``.

    Null texts are empty; an only document is its own next; equal ids are ordered by text hash;
    repeated rows get a row each; null ids come last; an empty table gives no rows.
    """
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(bins, bits, n)

        def finish(rows: list[tuple]) -> pa.RecordBatch:
            """Every row but the last, with the one after it."""
            texts = [r[2] for r in rows]
            edited = [t[:len(t) - len(t) // 3] + after[:len(t) // 3] for t, after in zip(texts, texts[1:])]
            raw = [e.encode() for e in edited]
            own = prints([t.encode() for t in texts])
            new = prints(raw)
            return pa.RecordBatch.from_arrays([
                pa.array([r[1] for r in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in raw]),
                pa.array([p.hex() for p in own[:-1]]), pa.array([p.hex() for p in new]),
                pa.array(prints.likeness(own[:-1], new)), pa.array(prints.likeness(own[:-1], own[1:]))],
                [f.split()[0] for f in schema.split(", ")])

        rows: list[tuple] = []
        size, closed = 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("range", "doc_id", "text", "guest")]
            for place, doc, text, guest in zip(*columns):
                if place == closed:
                    continue  # a guest repeated in full
                rows.append((place, doc, text or ""))
                size += len(rows[-1][2])
                if guest:
                    yield finish(rows)
                    rows, size, closed = [], 0, place
                elif size >= SLICE_BYTES // 2:
                    if len(rows) > 1:
                        yield finish(rows)
                    rows, size = rows[-1:], 0

    return with_next(docs, ranges, id_col, text_col).mapInArrow(pair, schema)
