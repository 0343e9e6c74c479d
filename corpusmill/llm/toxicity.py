"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over a text's distinct words and word beginnings is trained in numpy from
confirmed toxic examples and unlabelled text. Unlabelled text holds toxic examples too, so the risk
of calling it clean is corrected by the class prior, and that corrected part is kept from going
below zero (Kiryo et al. 2017). Weights are thinned by soft thresholding.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.samples import first_by_hash, known_labels, with_texts
from corpusmill.llm.words import SLICE_BYTES, WordTable, held_out, packed, slices, starts_of, texts_of
from corpusmill.runtime import lookup_join, stored

SPACE = 1 << 20  # hashed features
# Features in the patterns of unlabelled texts that the driver may hold.
DRIVER_CELLS = 4_000_000
BEGINNINGS = (4, 5, 6)
NOT_LETTERS = re.compile(r"[\W_]+")


def word_features(words: list[bytes]) -> np.ndarray:
    """Feature numbers of a word: the word itself and its beginnings; SPACE where there is none."""
    out = np.full((len(words), 1 + len(BEGINNINGS)), SPACE, np.int32)
    for i, raw in enumerate(words):
        word = NOT_LETTERS.sub("", raw.decode("utf-8", "replace").lower())
        if word:
            out[i, 0] = zlib.crc32(b"=" + word.encode()) % SPACE
            for j, n in enumerate(BEGINNINGS, 1):
                if len(word) > n:
                    out[i, j] = zlib.crc32(b"%d" % n + word[:n].encode()) % SPACE
    return out


def text_features(table: WordTable, texts: list[bytes]) -> list[np.ndarray]:
    """Distinct features of each text, sorted."""
    values, lengths = table(texts)
    runs = [np.unique(values[a:a + n]) if n else np.zeros(0, np.int32) for a, n in zip(starts_of(lengths), lengths)]
    return [r[r < SPACE].astype("<i4") for r in runs]


@dataclass
class LinearModel:
    """Weights of hashed features; the last place stands for no feature."""

    weights: np.ndarray
    bias: float

    def logits(self, table: WordTable, texts: list[bytes]) -> np.ndarray:
        values, lengths = table(texts)
        total = np.full(len(texts), self.bias)
        if len(values):
            owner = np.repeat(np.arange(len(texts)), lengths)
            row, column = np.nonzero(self.weights[values])
            # each feature of a text counts once
            pairs = np.unique(owner[row].astype(np.int64) * (SPACE + 1) + values[row, column])
            np.add.at(total, pairs // (SPACE + 1), self.weights[pairs % (SPACE + 1)].astype(np.float64))
        return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def without_copies(texts: list[np.ndarray], bands: int = 24, rows: int = 6, likeness: float = 0.8) -> list[np.ndarray]:
    """One text of each group of near copies, so that copied words don't count as many examples.

    A text goes only if the Jaccard likeness of its features with those of a kept text is ``likeness`` or
    more. MinHash values that agree in a band only propose the pairs to compare (with chance 0.999 at 0.8).
    Texts are taken in an order of their own, so what stays does not depend on the order they come in.
    """
    random = np.random.default_rng(11)
    flip = random.integers(0, 1 << 32, (bands * rows, 1), np.uint32)
    times = random.integers(0, 1 << 32, (bands * rows, 1), np.uint32) | np.uint32(1)
    distinct = {xxhash.xxh3_128_digest(t.tobytes()): t for t in texts if len(t)}
    texts = [distinct[k] for k in sorted(distinct)]
    keys = np.empty((bands, len(texts)), np.uint64)
    for i, text in enumerate(texts):
        least = ((text.astype(np.uint32)[None, :] ^ flip) * times).min(axis=1).reshape(bands, rows)
        keys[:, i] = [xxhash.xxh3_64_intdigest(band.tobytes()) for band in least]
    shared = np.zeros(keys.shape, bool)  # whether another text has the band's values too
    for band, mark in zip(keys, shared):
        _, back, n = np.unique(band, return_inverse=True, return_counts=True)
        mark[:] = n[back] > 1
    proposed: dict[tuple, list[int]] = {}
    kept = []
    for i, text in enumerate(texts):
        places = [(b, int(keys[b, i])) for b in np.flatnonzero(shared[:, i])]
        near = {j for place in places for j in proposed.get(place, ())}
        if any(_alike(text, kept[j], likeness) for j in sorted(near)):
            continue
        for place in places:
            proposed.setdefault(place, []).append(len(kept))
        kept.append(text)
    return kept


def _alike(a: np.ndarray, b: np.ndarray, likeness: float) -> bool:
    """Whether two sorted sets of features have a Jaccard likeness of ``likeness`` or more."""
    if min(len(a), len(b)) < likeness * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= likeness * (len(a) + len(b) - both)


class Patterns:
    """Unlabelled texts as patterns: sets of weighed features with their numbers of texts, on the driver."""

    def __init__(self, patterns: list[np.ndarray], counts: np.ndarray, total: int):
        self._flat = np.concatenate(patterns) if patterns else np.zeros(0, np.int64)
        self._owner = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
        self._counts, self._total = np.asarray(counts, float), total
        self._bare = total - self._counts.sum()  # texts without any weighed feature

    def sums(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """Mean loss of calling the texts clean, and its slope by weights and bias."""
        loss, slope = pattern_sums(self._flat, self._owner, self._counts, w, b)
        return _with_bare(loss, slope, self._bare, b, self._total)


class SparkPatterns:
    """The same for patterns that stay in a table (pattern, n): each call is a job that returns one sum per weight."""

    def __init__(self, table: DataFrame, held: int, total: int):
        self._table, self._bare, self._total = table, total - held, total

    def sums(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        shared = self._table.sparkSession.sparkContext.broadcast((w, b))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, bias = shared.value
            total = np.zeros(len(weights) + 2)
            for batch in batches:
                patterns = [np.frombuffer(p, "<i4") for p in batch.column("pattern").to_pylist()]
                if patterns:
                    owner = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
                    loss, slope = pattern_sums(np.concatenate(patterns), owner, batch.column("n").to_numpy().astype(float),
                                               weights, bias)
                    total += np.append(slope, loss)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "part"])

        rows = (self._table.mapInArrow(add, "place long, part double").groupBy("place").agg(F.sum("part").alias("part"))
                .collect())  # one row per weight
        total = np.zeros(len(w) + 2)
        for r in rows:
            total[r["place"]] = r["part"]
        shared.destroy()
        return _with_bare(total[-1], total[:-1], self._bare, b, self._total)


def pattern_sums(flat: np.ndarray, owner: np.ndarray, counts: np.ndarray, w: np.ndarray, b: float
                 ) -> tuple[float, np.ndarray]:
    """Summed loss of calling counted patterns clean, and its slope by weights and bias."""
    z = b + np.bincount(owner, w[flat], minlength=len(counts))
    slope = counts * sigmoid(z)
    return float((counts * np.logaddexp(0, z)).sum()), np.append(np.bincount(flat, slope[owner], minlength=len(w)), slope.sum())


def _with_bare(loss: float, slope: np.ndarray, bare: float, b: float, total: int) -> tuple[float, np.ndarray]:
    slope = slope.copy()
    slope[-1] += bare * float(sigmoid(np.array(b)))
    return (loss + bare * float(np.logaddexp(0, b))) / total, slope / total


def choose_features(positive: np.ndarray, n_positive: int, unlabelled: np.ndarray, n_unlabelled: int, prior: float,
                    least_texts: int = 3, least_precision: float = 0.5, least_deviations: float = 6.0) -> np.ndarray:
    """Features that point to the positive class, from the numbers of texts that hold each.

    In ``least_texts`` positive texts or more, whatever share of them that is, with an estimated share of positives
    among the texts that hold them of ``least_precision`` or more, and so many standard deviations more
    frequent than in unlabelled text.
    """
    often, usual = positive / n_positive, (unlabelled + 0.5) / (n_unlabelled + 1)
    deviations = (often - usual) / np.sqrt(usual / n_positive)
    return np.flatnonzero((positive >= least_texts) & (prior * often >= least_precision * usual)
                          & (deviations >= least_deviations))


def descend(positive: list[np.ndarray], unlabelled: Patterns | SparkPatterns, n_features: int, prior: float,
            steps: int = 300, rate: float = 0.05, thin: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk; positive texts as sets of weighed features.

    risk = prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]) with the logistic loss. While the
    second part is negative, a step climbs it again instead.
    """
    flat = np.concatenate(positive) if positive else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(positive)), [len(t) for t in positive])
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    moments = [np.zeros(n_features + 1), np.zeros(n_features + 1)]
    for step in range(1, steps + 1):
        z = b + np.bincount(owner, w[flat], minlength=len(positive))
        loss, slope = unlabelled.sums(w, b)
        up, down = -prior * sigmoid(-z) / len(positive), -prior * sigmoid(z) / len(positive)
        if loss - prior * np.logaddexp(0, z).mean() >= 0:
            own = up + down
        else:
            own, slope = -down, -slope
        grad = slope + np.append(np.bincount(flat, own[owner], minlength=n_features), own.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        move = rate * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - thin, 0)
    return w, float(b)


def _clipped(prior: float) -> float:
    return float(np.clip(prior, 1e-3, 0.999))


def _model(chosen: np.ndarray, w: np.ndarray, b: float) -> LinearModel:
    weights = np.zeros(SPACE + 1, np.float32)
    weights[chosen] = w
    return LinearModel(weights, b)


def _places(chosen: np.ndarray) -> np.ndarray:
    place = np.full(SPACE + 1, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    return place


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, **options) -> LinearModel:
    """Train a linear classifier on feature lists by the non-negative risk estimator; of near copies one is used.

    Without positive or unlabelled texts the model is the prior alone.
    """
    prior = _clipped(prior)
    positive, unlabelled = without_copies(positive), without_copies(unlabelled)
    if not positive or not unlabelled:
        return _model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    counts = [np.bincount(np.concatenate(x), minlength=SPACE) for x in (positive, unlabelled)]
    chosen = choose_features(counts[0], len(positive), counts[1], len(unlabelled), prior)
    place = _places(chosen)
    sides = [[p[p >= 0] for p in (place[t] for t in side)] for side in (positive, unlabelled)]
    return _model(chosen, *descend(sides[0], Patterns(sides[1], np.ones(len(unlabelled)), len(unlabelled)), len(chosen),
                                   prior, **options))


def _distinct_texts(docs: DataFrame, remainder: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` of all documents that are not held out, of equal texts the one with the smallest id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).filter(
        F.col("doc_id").isNotNull() & ~held_out("doc_id", remainder)).withColumn("mark", F.xxhash64("text"))
    copied = stored(texts.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").select("mark", "first"), "toxicity-copies")
    rows = lookup_join(texts, copied, ["mark"], "left", spread=["doc_id"])
    return rows.filter(F.col("first").isNull() | (F.col("first") == F.col("doc_id"))).select("doc_id", "text")


def _held_features(texts: DataFrame, features: np.ndarray) -> DataFrame:
    """``places``: for every text, which of the given features it holds, as little-endian 32-bit numbers."""
    shared = texts.sparkSession.sparkContext.broadcast(_places(features).astype(np.int32))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, place = WordTable(word_features), shared.value
        for part in slices(batches, "text", 1 << 20):  # most words of a text hold candidates
            values, lengths = table(texts_of(part.column("text")))
            found = place[values] if len(values) else np.zeros((0, 1), np.int32)
            row, column = np.nonzero(found >= 0)
            owner = np.repeat(np.arange(len(lengths)), lengths)[row] if len(row) else np.zeros(0, np.int64)
            pairs = np.unique((owner.astype(np.int64) << 32) + found[row, column])
            cuts = np.searchsorted(pairs >> 32, np.arange(1, len(lengths)))
            runs = np.split((pairs & 0xFFFFFFFF).astype("<i4"), cuts)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in runs[:len(lengths)]], pa.binary())], ["places"])

    return texts.select("text").mapInArrow(hold, "places binary")


def _counts(held: DataFrame, n: int) -> np.ndarray:
    """Number of texts that hold each feature, over all texts; summed in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("places").to_pylist()), "<i4"), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    out = np.zeros(n, np.int64)
    for r in held.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]  # one row per feature of the confirmed texts
    return out


def _patterns(held: DataFrame, place: np.ndarray) -> DataFrame:
    """``pattern, n``: the sets of weighed features that occur, with their number of texts."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for places in batch.column("places").to_pylist():
                weighed = place[np.frombuffer(places, "<i4")]
                weighed = weighed[weighed >= 0]
                if len(weighed):
                    found[weighed.astype("<i4").tobytes()] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                                             ["pattern", "n"])

    return held.mapInArrow(reduced, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, remainder: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", driver_cells: int = DRIVER_CELLS,
                   **options) -> LinearModel:
    """Fit on at most ``max_positive`` confirmed toxic texts and all unlabelled texts.

    Confirmed texts are the first by a hash of the id among labelled ids that are not held out; of their near
    copies one is used. Everything else covers all documents that are not held out, of equal texts one: the
    number of texts that hold each feature of the confirmed ones, from which features are chosen, and the
    risk of the unlabelled texts, which are reduced to the sets of chosen features that they hold. Up to
    ``driver_cells`` features in such sets the risk is summed on the driver, beyond that where they lie.
    Labels other than 1 are used for the class prior only, which is counted over all labelled ids that are
    not held out.

    Null ids and labels are passed over, a null text is empty, an id labelled twice is toxic if it is so once,
    repeated rows are equal texts. Without confirmed texts or documents the model is the prior alone.
    """
    known = known_labels(labels, "toxic", id_col, remainder)
    prior = _clipped(known.agg(F.avg((F.col("label") == 1).cast("double")).alias("p")).first()["p"] or 0.0)
    toxic = first_by_hash(known.filter("label = 1").select("doc_id"), max_positive)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(word_features)
        for part in slices(batches, "text"):
            found = text_features(table, texts_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in found], pa.binary())], ["features"])

    rows = with_texts(toxic, docs, id_col, text_col).select("text").mapInArrow(featurise, "features binary").collect()
    positive = without_copies([np.frombuffer(r["features"], "<i4") for r in rows])
    bare = _model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not positive:
        return bare
    counts = np.bincount(np.concatenate(positive), minlength=SPACE)
    candidates = np.flatnonzero(counts >= 3)
    held = stored(_held_features(_distinct_texts(docs, remainder, id_col, text_col), candidates), "toxicity-features")
    total = held.count()
    if not total:
        return bare
    chosen = choose_features(counts[candidates], len(positive), _counts(held, len(candidates)), total, prior)
    place = np.full(len(candidates), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    patterns = stored(_patterns(held, place), "toxicity-patterns")
    size = patterns.agg(F.sum("n").alias("n"), F.sum(F.octet_length("pattern") / 4).alias("cells")).first()
    if (size["cells"] or 0) <= driver_cells:
        listed = patterns.orderBy("pattern").collect()
        unlabelled = Patterns([np.frombuffer(r["pattern"], "<i4") for r in listed], [r["n"] for r in listed], total)
    else:
        unlabelled = SparkPatterns(patterns, size["n"] or 0, total)
    weighed = _places(candidates[chosen])
    sides = [p[p >= 0] for p in (weighed[t] for t in positive)]
    return _model(candidates[chosen], *descend(sides, unlabelled, len(chosen), prior, **options))


def scorer(spark: SparkSession, model: LinearModel):
    """The model as a column function from text to score; the model is of fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, known = WordTable(word_features), shared.value
        for column in columns:
            texts = [(t or "").encode() for t in column]
            out, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < SLICE_BYTES):
                    size += len(texts[end])
                    end += 1
                out.append(sigmoid(known.logits(table, texts[at:end])))
                at = end
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def score_toxicity(docs: DataFrame, model: LinearModel, threshold: float = 0.5, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted``: a score of 0 to 1 for every whole text, and 1 from ``threshold`` up.

    Only the text is an input. A null or empty text scores the model's bias; repeated rows are scored
    each; a null id stays null; an empty table gives no rows. No shuffle.
    """
    score = scorer(docs.sparkSession, model)
    scored = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id",
               text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the trained classifier doesn't call toxic, with all their columns.

    A null or empty text scores the model's bias, as a row without a known word does; a row without an id is judged
    like any other; repeated rows stay or go together; ties with the threshold go. An empty table gives no rows.
    """
    model = train_toxicity(docs, labels, id_col=id_col, text_col=text_col, **options)
    rows = packed(docs, text=F.col(text_col))
    return rows.filter(scorer(docs.sparkSession, model)("text") < threshold).select("doc.*")
