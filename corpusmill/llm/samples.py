"""Bounded samples of documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import held_out


def known_labels(labels: DataFrame, label: str, id_col: str = "doc_id", remainder: int = 0) -> DataFrame:
    """``doc_id, label`` of labelled ids that are not held out; an id labelled twice has the larger label."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return (known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id", remainder))
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def first_by_hash(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, those whose ids come first in a fixed hash order."""
    return ids.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(limit)


def with_texts(ids: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled ids with their whole texts; of texts that share an id, the first by hash."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")  # bounded by the sample's limit
    return found.groupBy(*ids.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
