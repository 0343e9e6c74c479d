"""Collection bookkeeping: processed-file ledger, audits, exact duplicates, reports."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.runtime import lookup_join


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files the ledger does not list yet."""
    return files.join(ledger.select("file_name"), "file_name", "left_anti")


def append_ledger(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger with the given files added once."""
    return ledger.select("file_name").unionByName(files.select("file_name")).distinct()


def union_corpora(*corpora: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), corpora)


def missing_pages(landed: DataFrame, total: int | DataFrame, page_size: int) -> DataFrame:
    """Page numbers from 1 that should exist for ``total`` records but were not landed.

    ``total`` is a number or a one-row DataFrame with a column ``total``.
    """
    spark = landed.sparkSession
    asked = spark.range(1).select(F.lit(total).alias("total")) if isinstance(total, int) else total
    pages = asked.select(text.page_count("total", page_size).alias("pages")).filter("pages > 0")
    # The numbers are laid out in blocks, so a long list is not built inside one row.
    block = 10_000
    blocks = pages.select("pages", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("pages") - 1) / block)))
                          .alias("b"))
    spread = blocks.repartition("b").select(F.explode(F.sequence(
        F.col("b") * block + 1, F.least(F.col("pages"), (F.col("b") + 1) * block))).alias("page_no"))
    return spread.join(landed.select("page_no"), "page_no", "left_anti")


def filter_base_date(df: DataFrame, column: str, low: str, high: str, fmt: str = "yyyyMMdd") -> DataFrame:
    """Rows whose date lies between two days given as text, both included. The bounds are literals for the scan."""
    pattern = fmt.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d")
    first = datetime.strptime(low, pattern)
    after = datetime.strptime(high, pattern) + timedelta(days=1)
    kind = df.schema[column].dataType.simpleString()
    if kind == "string":
        return df.filter(F.col(column).between(low, high))
    return df.filter((F.col(column) >= F.lit(first).cast(kind)) & (F.col(column) < F.lit(after).cast(kind)))


def dedup_exact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct cleaned text: its hash, smallest id and number of copies.

    Only the hash is shuffled, and counts combine first, so a mass of copies stays cheap.
    """
    hashed = df.select(F.sha1(text.clean_text(text_col)).alias("text_hash"), id_col)
    return hashed.groupBy("text_hash").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def ingest_report(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Documents per file and, in the row with a NULL file, in total."""
    return df.rollup(file_col).agg(F.count(F.lit(1)).alias("documents"))


def corpus_health(df: DataFrame) -> DataFrame:
    """Number of documents and of documents without metadata."""
    return df.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("metadata").isNull()).alias("null_metadata"))


def upsert(corpus: DataFrame, changes: DataFrame, key: str = "doc_id", small: bool | None = None) -> DataFrame:
    """Corpus with the changed documents replaced or added. A small change set never shuffles the corpus."""
    kept = lookup_join(corpus, changes.select(key), [key], "left_anti", small=small)
    return kept.unionByName(changes, allowMissingColumns=True)


def delete(corpus: DataFrame, ids: DataFrame, key: str = "doc_id", small: bool | None = None) -> DataFrame:
    """Corpus without the listed ids."""
    return lookup_join(corpus, ids.select(key), [key], "left_anti", small=small)


def attribute_search(df: DataFrame, equals: dict | None = None, contains: dict | None = None) -> DataFrame:
    """Rows whose fields equal, or contain, the given values; equalities reach the scan."""
    tests: list[Column] = [F.col(c) == v for c, v in (equals or {}).items()]
    tests += [F.col(c).contains(v) for c, v in (contains or {}).items()]
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def top_rate_products(df: DataFrame, rate: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest rate: a bounded heap per partition, then a merge."""
    return df.orderBy(F.col(rate).desc_nulls_last(), F.col(key)).limit(n)
