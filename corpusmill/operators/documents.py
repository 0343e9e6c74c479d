"""From product tables to documents: cleaning, narrative text, key summary, metadata, grouping."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators.ordinals import first_n, key_ordinal, ordered_concat, row_ordinal
from corpusmill.runtime import lookup_join, stored
from corpusmill.schema import MISSING, MISSING_CELLS, SOLDIER_SAVINGS_GUIDE, STRING_MAP, SheetSpec


def q(name: str) -> Column:
    """Column by its exact name; sheet headers hold dots, spaces and brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns without a header (also the ``_cN`` names Spark gives them)."""
    kept = [c for c in df.columns if c.strip() and not c.startswith("Unnamed") and not re.fullmatch(r"_c\d+", c)]
    return df.select(*[q(c) for c in kept])


def fill_missing(df: DataFrame, sentinel: str = MISSING, columns: list[str] | None = None) -> DataFrame:
    names = df.columns if columns is None else columns
    return df.withColumns({c: F.coalesce(q(c).cast("string"), F.lit(sentinel)) for c in names})


def clean_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = df.columns if columns is None else columns
    return df.withColumns({c: text.clean_text(q(c)) for c in names})


def missing_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL for cells whose text means "no value"."""
    return df.withColumns({c: F.when(~q(c).isin(*MISSING_CELLS), q(c)) for c in columns})


def render_numbers(df: DataFrame, columns: list[str], file_col: str | None = "source_file") -> DataFrame:
    """Print number columns as a typed reader would: ``2.70`` becomes ``2.7``.

    A column is numeric in a file if all its non-null cells are numbers, and integral if all are
    integers and none is missing. Both facts are gathered for all columns in one aggregation.
    """
    integral = r"\A\s*[+-]?[0-9]+\s*\z"
    facts = []
    for i, c in enumerate(columns):
        number = q(c).try_cast("double").isNotNull() & ~q(c).rlike(r"[dDfF]\s*\z")
        facts += [F.bool_and(q(c).isNull() | number).alias(f"_num{i}"),
                  F.bool_and(F.coalesce(q(c).rlike(integral), F.lit(False))).alias(f"_int{i}")]
    file = F.lit(None).cast("string") if file_col is None else q(file_col)
    df = df.withColumns({"_no_file": file.isNull(), "_file": F.coalesce(file.cast("string"), F.lit(""))})
    flags = stored(df.groupBy("_no_file", "_file").agg(*facts), "column-kinds")
    joined = lookup_join(df, flags, ["_no_file", "_file"], "inner", spread=list(columns))
    shown = {}
    for i, c in enumerate(columns):
        whole = q(c).try_cast("decimal(38,0)").cast("string")
        shown[c] = (F.when(F.col(f"_int{i}"), F.coalesce(whole, q(c)))
                    .when(F.col(f"_num{i}"), text.python_float(q(c).try_cast("double")))
                    .otherwise(q(c)))
    helpers = [f"_{kind}{i}" for kind in ("num", "int") for i in range(len(columns))]
    return joined.withColumns(shown).drop(*helpers, "_no_file", "_file")


def narrative(columns: list[str]) -> Column:
    """``name: value`` lines in column order."""
    return F.concat_ws("\n", *[text.line(c, q(c)) for c in columns])


def key_summary(columns: list[str], keys: list[str] | tuple[str, ...]) -> Column:
    """``key: value`` of the chosen columns that carry information, comma-joined."""
    items = [F.when(text.present(q(k)), text.line(k, text.strip_text(q(k)))) for k in keys if k in columns]
    joined = F.concat_ws(", ", *items)
    return F.when(joined == "", F.lit(MISSING)).otherwise(joined)


def metadata_map(columns: list[str], summary: Column) -> Column:
    """All columns as a string map plus the key summary, which replaces a column of that name."""
    kept = [c for c in columns if c != "key_summary"]
    pairs = reduce(lambda a, c: [*a, F.lit(c), q(c)], kept, [])
    return F.create_map(*pairs, F.lit("key_summary"), summary).cast(STRING_MAP)


def build_documents(df: DataFrame, spec: SheetSpec, ordinal: str = "row_ordinal",
                    extra: tuple[str, ...] = ("source_file",), render: bool = True) -> DataFrame:
    """One document per row of a product sheet.

    ``ordinal`` and the ``extra`` columns are bookkeeping and do not enter the text. A sheet whose
    cells are plain texts already printed as wanted can skip the numeric rendering pass.
    """
    keep = [c for c in (*extra, ordinal) if c in df.columns]
    data = [c for c in drop_unnamed(df.drop(*keep)).columns]
    if render:
        df = render_numbers(missing_cells(df, data), data, "source_file" if "source_file" in keep else None)
    df = fill_missing(df, columns=data)
    if spec.clean_cells:
        df = clean_columns(df, data)
    summary = key_summary(data, spec.key_fields)
    bank = q(spec.bank_field) if spec.bank_field in data else F.lit(MISSING)
    if spec.product_field is None:
        product = bank
    else:
        product = q(spec.product_field) if spec.product_field in data else F.lit(MISSING)
    return df.select(
        text.doc_id(spec.id_prefix, F.col(ordinal)).alias("id"),
        bank.alias("bank"), product.alias("product_name"), F.lit(spec.doc_type).alias("type"),
        narrative(data).alias("content"), summary.alias("key_summary"),
        metadata_map(data, summary).alias("metadata"), *[F.col(c) for c in extra if c in keep])


def valid_documents(df: DataFrame) -> DataFrame:
    """Documents that have content; missing metadata becomes an empty map."""
    empty = F.create_map().cast(STRING_MAP)
    return df.filter(F.col("content").isNotNull()).withColumn("metadata", F.coalesce("metadata", empty))


# --- category sheets: many rows make one document ------------------------------------------------


def clean_category_rows(df: DataFrame) -> DataFrame:
    """Columns category, item, value, row_ordinal with missing cells filled and texts cleaned."""
    texts = ["category", "item", "value"]
    return clean_columns(fill_missing(missing_cells(df, texts), columns=texts), texts)


def with_part(rows: DataFrame, lines_per_document: int | None) -> DataFrame:
    """Add ``part``: 0, or the number of the run of ``lines_per_document`` rows a row is in."""
    if lines_per_document is None:
        return rows.withColumn("part", F.lit(0).cast("long"))
    numbered = row_ordinal(rows, "category", ["row_ordinal"], "_line")
    return numbered.withColumn("part", F.floor(F.col("_line") / lines_per_document).cast("long")).drop("_line")


def category_content(parted: DataFrame) -> DataFrame:
    """category, part, content: the category line and one ``item: value`` line per row."""
    lines = parted.select("category", "part", "row_ordinal", F.concat("item", F.lit(": "), "value").alias("line"))
    body = ordered_concat(lines, ["category", "part"], "row_ordinal", "line", "\n", "body")
    head = F.concat(F.lit("카테고리: "), F.col("category"), F.lit("\n"))
    return body.select("category", "part", F.concat(head, F.col("body")).alias("content"))


def category_metadata(parted: DataFrame) -> DataFrame:
    """category, part, item, value: values of a repeated item joined by `` / `` in row order."""
    cells = parted.select("category", "part", "item", "row_ordinal", "value")
    return ordered_concat(cells, ["category", "part", "item"], "row_ordinal", "value", " / ", "value")


def category_summary(rows: DataFrame, n: int = 2, width: int = 50, by: tuple[str, ...] = ("category",)) -> DataFrame:
    """category, key_summary: the first rows of the category, values shortened."""
    top = first_n(rows, list(by), [F.col("row_ordinal")], n)
    item = F.concat("item", F.lit(": "), text.ellipsis("value", width))
    listed = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", item.alias("s")))).alias("l"))
    return listed.select(*by, F.array_join(F.transform("l", lambda x: x["s"]), ", ").alias("key_summary"))


def category_documents(rows: DataFrame, spec: SheetSpec = SOLDIER_SAVINGS_GUIDE,
                       lines_per_document: int | None = None) -> DataFrame:
    """One document per category, numbered by sorted category, whatever its size.

    With ``lines_per_document`` a category comes as several documents of that many rows, each made from
    its own rows as a category would be. The first keeps the category's id, the others add their number
    to it, so no two documents share an id. ``part`` is that number.
    """
    parted = with_part(rows, lines_per_document)
    key = ["category", "part"]
    summary = category_summary(parted, by=tuple(key))
    numbers = key_ordinal(rows, "category", "ordinal")
    entry = F.struct(F.col("item").alias("key"), F.col("value").alias("value"))
    maps = (category_metadata(parted).filter(F.col("item") != "key_summary").groupBy(*key)
            .agg(F.map_from_entries(F.collect_list(entry)).alias("m")))
    empty = F.create_map().cast(STRING_MAP)
    joined = category_content(parted).join(summary, key).join(numbers, "category").join(maps, key, "left")
    own = F.create_map(F.lit("key_summary"), F.col("key_summary"))
    first = text.doc_id(spec.id_prefix, F.col("ordinal"))
    doc_id = F.when(F.col("part") == 0, first).otherwise(F.concat(first, F.lit("_"), F.col("part").cast("string")))
    return joined.select(
        doc_id.alias("id"), F.lit(MISSING).alias("bank"), F.col("category").alias("product_name"),
        F.lit(spec.doc_type).alias("type"), "part", "content", "key_summary",
        F.map_concat(F.coalesce("m", empty), own).alias("metadata"))
