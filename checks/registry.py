"""Name -> Spark query and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The test tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None):
    """Register a function of the tables under its own name."""

    def register(run: Callable[[Tables], DataFrame]):
        name = run.__name__
        QUERIES[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return run

    return register
