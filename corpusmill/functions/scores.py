"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Okapi BM25 defaults.
K1 = 1.5
B = 0.75
EPSILON = 0.25

# Fixed value: guard in the min-max denominator.
MINMAX_GUARD = 1e-6


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def floored_idf(idf: Column, mean_idf: Column, epsilon: float = EPSILON) -> Column:
    return F.when(idf >= 0, idf).otherwise(F.lit(epsilon) * mean_idf)


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """Saturated term frequency of BM25, to be multiplied by idf."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def minmax(score: Column, low: Column, high: Column) -> Column:
    return (score - low) / (high - low + MINMAX_GUARD)


def cosine_sim01(distance: Column) -> Column:
    """Cosine distance in [0, 2] to a similarity in [0, 1]."""
    return 1 - distance / 2


def round4(c: Column) -> Column:
    return F.round(c, 4)


def order_score(c: Column) -> Column:
    """Score used for ranking: equal documents tie although their sums were added in another order."""
    return F.round(c, 9)
