"""Positions of rows: inside a file, inside a group, over a whole table.

No position is computed by sending a file or a group to one task. Rows keep their place in the split
or in the range partition they already sit in; only the counts per split travel, and they become
offsets. A file or group holding most of the rows is therefore numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.runtime import lookup_join, scratch_dir, stored


def file_ordinals(scan: DataFrame, name: str = "row_ordinal") -> DataFrame:
    """Number the rows of each file of a file scan from 0, in file order, without a shuffle.

    ``scan`` must be a plain file read. It is read once and written with each row's split and place, so
    both passes below agree however the files are split among tasks. Rows of a split are numbered by
    their place in it; the row counts of a file's earlier splits are added. Adds ``source_file`` (the
    path) too.
    """
    placed = stored(scan.select(
        "*", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place")), "numbered")
    blocks = placed.groupBy("source_file", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(blocks.select("source_file", "_block", "_first",
                                   F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")), "offsets")
    joined = lookup_join(placed, offsets, ["source_file", "_block"], "inner", spread=["_place"])
    ordinal = F.col("_place") - F.col("_first") + F.col("_offset")
    return joined.withColumn(name, ordinal).drop("_block", "_place", "_first", "_offset")


def global_ordinals(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number all rows from 0 in sort order.

    The rows are range-partitioned and sorted once and written; a row's place in its file plus the
    sizes of the files before it is its position. The written table makes both passes agree even if
    an executor is lost in between.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "ordered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    # Files are named by their partition's number, of five digits or more.
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    placed = stored.select("*", number.alias("_file"), F.col("_metadata.row_index").alias("_index"))
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    joined = lookup_join(placed, offsets, ["_file"], "inner", spread=["_index"])
    return joined.withColumn(name, F.col("_index") + F.col("_offset")).drop("_file", "_index", "_offset")


def row_ordinal(df: DataFrame, by: str | list[str], order: list[str], name: str = "row_ordinal") -> DataFrame:
    """Number the rows of each group from 0 in the given order.

    Position in the whole sort order minus the group's first position, so a group holding a third of
    the table is spread over many tasks.
    """
    by = [by] if isinstance(by, str) else by
    placed = global_ordinals(df, [*by, *order], "_position")
    starts = stored(placed.groupBy(*by).agg(F.min("_position").alias("_start")), "starts")
    joined = lookup_join(placed, starts, by, "inner", spread=["_position"])
    return joined.withColumn(name, F.col("_position") - F.col("_start")).drop("_position", "_start")


def key_ordinal(df: DataFrame, key: str, name: str = "key_ordinal") -> DataFrame:
    """Position of each distinct key in sorted order: one row per key."""
    return global_ordinals(df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")), [key], name).drop("rows")


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """First ``n`` rows of each group; the limit is applied in each partition before the shuffle."""
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.filter(F.col(name) <= n)


def ordered_concat(df: DataFrame, by: list[str], order: str, value: str, sep: str, name: str = "text") -> DataFrame:
    """Concatenate ``value`` per group in row order: ``by``, ``name``.

    The text is one cell of the result, so a group's values meet in one task. Callers bound groups
    where they may be large.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return df.groupBy(*by).agg(F.array_join(ordered, sep).alias(name))
