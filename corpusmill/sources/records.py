"""Records collected page by page: XML pages in, CSV out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_xml_items(spark: SparkSession, path: str, row_tag: str = "item", fields: list[str] | None = None) -> DataFrame:
    """One row per item element, one text column per child tag; a missing tag is NULL.

    Without ``fields`` the union of the child tags is found by a pass over the pages.
    """
    reader = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False)
    if fields is not None:
        reader = reader.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    return reader.load(path)


def read_page_totals(spark: SparkSession, path: str, tag: str = "totalCount") -> DataFrame:
    """The record total announced by the landed pages, as one row ``total``."""
    pages = spark.read.text(path)
    found = F.regexp_extract("value", rf"<{tag}>\s*(\d+)\s*</{tag}>", 1).try_cast("long")
    return pages.agg(F.max(found).alias("total"))


def write_records_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column (UTF-8 without byte-order mark)."""
    (df.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_records_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).csv(path))
