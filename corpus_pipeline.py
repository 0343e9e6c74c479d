"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.mixing import mixed_documents
from corpusmill.llm.ngram_join import drop_near_duplicates
from corpusmill.llm.packing import pack_documents
from corpusmill.llm.secrets import redact_secrets
from corpusmill.llm.toxicity import keep_clean
from corpusmill.runtime import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained from ``labels`` on these documents, doesn't reject.

    Null and empty texts score the prior; repeated rows stay or go together; without labels nothing goes unless the
    prior itself says so, and an empty table gives no rows. So it is for null ids and any source.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Null, empty and blank texts are copies of each other; null ids come last; of rows repeated in full one stays; an
    empty table gives no rows.
    """
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blotted out and ``n_chars`` set anew.

    Null texts stay null, empty ones empty, repeated rows and null ids as they are; an empty table gives no rows.
    """
    return redact_secrets(docs, length_col="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the copies in training order.

    A null source is a source of its own, the last; texts without words cost nothing and are kept once; repeated rows
    count each; ties go by a hash of id and size, then id. An empty table gives no rows.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, dealt to sequences.

    A null or empty text is the end id alone, repeated rows are packed each, very long texts are cut, null ids stay null,
    and an empty table gives no rows.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing),
          ("packing", packing)]

# Learnt scores and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
