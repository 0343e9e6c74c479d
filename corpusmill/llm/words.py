"""Words, word hashes and word n-grams of whole texts, as numpy arrays.

A word is a maximal run of bytes other than space and the ASCII controls 9 to 13, which is what
``bytes.split`` cuts. Texts are handled as UTF-8 bytes in bounded slices of an Arrow batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts are taken from an Arrow batch in slices of about so many bytes (one text at least).
SLICE_BYTES = 4 << 20
# Distinct words that a task remembers before it starts afresh; only a saving.
REMEMBERED = 250_000

ODD = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows holding about ``limit`` bytes in ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


class Codes(dict):
    """Word -> running number, growing as words are met."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class WordTable:
    """Numbers words and keeps one value per distinct word, computed by ``value`` on first sight.

    After more than ``remembered`` distinct words it starts afresh at the next call.
    """

    def __init__(self, value: Callable[[list[bytes]], np.ndarray], remembered: int = REMEMBERED):
        self._value, self._remembered = value, remembered
        self._reset()

    def _reset(self) -> None:
        self._codes, self._values, self._known = Codes(), None, 0

    def codes(self, texts: list[bytes], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words in order, and the number of words of each text; ``end`` closes each text."""
        if len(self._codes) > self._remembered:
            self._reset()
        number = self._codes.__getitem__
        runs, lengths = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.split()
            if end is not None:
                words.append(end)
            lengths[i] = len(words)
            runs.append(np.fromiter(map(number, words), np.int64, len(words)))
        if len(self._codes) > self._known:
            fresh = self._value(list(self._codes)[self._known:])
            if self._values is None:
                self._values = fresh
            else:
                if len(self._values) < len(self._codes):
                    room = np.empty((max(2 * len(self._values), len(self._codes)), *fresh.shape[1:]), fresh.dtype)
                    room[:self._known] = self._values[:self._known]
                    self._values = room
                self._values[self._known:len(self._codes)] = fresh
            self._known = len(self._codes)
        return (np.concatenate(runs) if runs else np.zeros(0, np.int64)), lengths

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.zeros(0) if self._values is None else self._values[codes]

    def words(self) -> list[bytes]:
        """All words by number."""
        return list(self._codes)

    def __len__(self) -> int:
        return len(self._codes)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all words in order, and the number of words of each text."""
        codes, lengths = self.codes(texts)
        return self.values(codes), lengths


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (Stafford's variant 13 of the murmur finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def shingles(hashes: np.ndarray, lengths: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ``n`` consecutive words at each place, and their number per text.

    A text of 1 to n-1 words has one shingle, all its words; a text without words has none.
    """
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
    short = (lengths > 0) & (lengths < n)
    if short.any():  # fill up with zeros, which stand for no word
        padded = np.where(short, n, lengths)
        room = np.zeros(int(padded.sum()), np.uint64)
        place = np.repeat(starts_of(padded) - starts_of(lengths), lengths) + np.arange(len(hashes))
        room[place] = hashes
        hashes, lengths = room, padded
    counts = np.maximum(lengths - n + 1, 0)
    at = np.arange(int(counts.sum())) + np.repeat(starts_of(lengths) - starts_of(counts), counts)
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            total = total * ODD + mix(hashes[at + j] + np.uint64(j + 1))
        return mix(total), counts


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns as one struct ``doc`` beside key columns, so that no names can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("doc"), *[c.alias(name) for name, c in keys.items()])


def held_out(doc_id: Column | str, remainder: int, parts: int = 5) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` (a null id never does)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == remainder, F.lit(False))


def crc_of(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode())
