"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few statistics. Statistics are cut into bins at quantiles of the training
sample. Shallow trees over one statistic at a time are boosted in turn and summed into one look-up
table per statistic; then trees over the strongest pairs are boosted into two-dimensional tables
(Lou et al. 2013). A score is the sum of the table cells of a text's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.samples import first_by_hash, known_labels, with_texts
from corpusmill.llm.toxicity import sigmoid
from corpusmill.llm.words import held_out, slices, texts_of

BYTES = np.arange(256)
CLASSES = {
    "upper": (BYTES >= 65) & (BYTES <= 90), "lower": (BYTES >= 97) & (BYTES <= 122),
    "digit": (BYTES >= 48) & (BYTES <= 57), "stop": np.isin(BYTES, list(b".,;:?'\"-")),
    "shout": BYTES == 33, "bar": BYTES == 124, "sign": np.isin(BYTES, list(b"#$%&*+/<=>@[\\]^_`{}~()")),
    "blank": np.isin(BYTES, [9, 10, 11, 12, 13, 32]), "beyond": BYTES >= 128, "control": BYTES < 9,
}
STATISTICS = [*CLASSES, "words", "word_length", "distinct", "lines", "repeated_lines", "line_words", "longest",
              "commonest"]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text; a text without words has zeros for shares."""
    masks = np.array(list(CLASSES.values()), np.float64)
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        if not text:
            continue
        out[i, :len(CLASSES)] = masks @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
        words = text.split()
        if not words:
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lines = [line for line in text.split(b"\n") if line.strip()]
        counts: dict[bytes, int] = {}
        for word in words:
            counts[word] = counts.get(word, 0) + 1
        out[i, len(CLASSES):] = (
            np.log1p(len(words)), lengths.mean(), len(counts) / len(words), np.log1p(len(lines)),
            1 - len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), np.log1p(lengths.max()),
            max(counts.values()) / len(words))
    return out


@dataclass
class AdditiveModel:
    """Bin edges, one table per statistic and one per chosen pair."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        bins = [np.searchsorted(self.coarse[j], x[:, j], side="right") for j in range(len(self.coarse))]
        for i, j, table in self.pairs:
            total += table[bins[i], bins[j]]
        return total


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, low: int, high: int, ridge: float) -> tuple[float, int]:
    """(gain, place) of the best cut of bins low..high by gradient and curvature sums."""
    if high - low < 2:
        return 0.0, -1
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    gain = (left_g ** 2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge)
            - all_g ** 2 / (all_h + ridge))
    best = int(np.argmax(gain))
    return float(gain[best]), low + best + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Step function over bins: the best cuts one after another, a Newton step in each leaf."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g, h, a, b, ridge), a, b) for a, b in parts]
        gain, place, a, b = max(cuts)
        if place < 0 or gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, place), (place, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, table) of a tree that cuts one side once and each half of the other side once."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            table, gain = np.zeros_like(a), -a.sum() ** 2 / (b.sum() + ridge)
            for rows in (slice(0, cut), slice(cut, len(a))):
                half_g, half_h = a[rows].sum(axis=0), b[rows].sum(axis=0)
                table[rows] = _tree(half_g, half_h, 2, ridge)
                gain += half_g.sum() ** 2 / (half_h.sum() + ridge) + max(_best_cut(half_g, half_h, 0, len(half_g),
                                                                                    ridge)[0], 0)
            if gain > best[0]:
                best = (gain, table.T if turned else table)
    return best


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.1, leaves: int = 3,
                 n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 20, ridge: float = 2.0) -> AdditiveModel:
    """Boost look-up tables for the logistic loss; without both labels the model is its bias alone."""
    n, width = x.shape
    edges = [_cuts(x[:, j], bins) for j in range(width)]
    coarse = [_cuts(x[:, j], pair_bins) for j in range(width)]
    share = (y.sum() + 0.5) / (n + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], coarse)
    if not n or y.min() == y.max():
        return model
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    z = np.full(n, model.bias)
    for _ in range(rounds):
        for j in range(width):
            p = sigmoid(z)
            g = np.bincount(at[j], p - y, minlength=len(edges[j]) + 1)
            h = np.bincount(at[j], p * (1 - p), minlength=len(edges[j]) + 1)
            step = rate * _tree(g, h, leaves, ridge)
            model.tables[j] += step
            z += step[at[j]]

    near = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(z)
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = near[i] * shape[1] + near[j]
        return tuple(np.bincount(cell, v, minlength=shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p)))

    gains = sorted(((_pair_tree(*sums(i, j), ridge)[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            step = rate * _pair_tree(*sums(i, j), ridge)[1]
            table += step
            z += step[near[i], near[j]]
    model.pairs = chosen
    return model


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 30000, remainder: int = 0,
                  id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on a bounded sample: at most ``max_rows`` labelled texts, the first by a hash of the id.

    Held-out ids, null ids and null labels are not used. A null or empty text has the statistics of no words; of
    texts that share an id the first by hash is used, an id labelled twice has the larger label, so repeated rows
    change nothing. Without labelled texts the model is a constant.
    """
    chosen = first_by_hash(known_labels(labels, "quality", id_col, remainder), max_rows)
    schema = "label int, statistics array<double>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = statistics(texts_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                                             ["label", "statistics"])

    rows = with_texts(chosen, docs, id_col, text_col).select("label", "text").mapInArrow(measure, schema).collect()
    x = np.array([r["statistics"] for r in rows]).reshape(len(rows), len(STATISTICS))
    y = np.array([float(r["label"] == 1) for r in rows])
    order = np.lexsort(x.T)  # rows arrive in any order; sums of floats should not depend on it
    return fit_additive(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; higher is better, 1 from ``threshold`` up.

    Only the text is an input. A null text is empty; repeated rows are scored each; a null id stays
    null; an empty table gives no rows. No shuffle; the model is of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            scores = sigmoid(shared.value.logits(statistics(texts_of(part.column("text")))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(score, "doc_id long, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
