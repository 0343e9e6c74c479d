"""Product sheets: flat, two-level header, and long category/item/value CSV files."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.documents import q
from corpusmill.operators.ordinals import file_ordinals
from corpusmill.runtime import lookup_join
from corpusmill.schema import CATEGORY_SHEET

# More different headers than this at one path are an error.
MOST_HEADERS = 100


def _csv(spark: SparkSession, multi_line: bool):
    # Cells hold quoted line breaks, so a sheet is read whole by one task unless multi_line is off.
    return (spark.read.option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE"))


def unique_names(names: list[str]) -> list[str]:
    """A repeated header gets ``.1``, ``.2`` appended; a blank one is named like an unnamed column."""
    seen: dict[str, int] = {}
    result = []
    for i, name in enumerate(names):
        name = name if name else f"Unnamed: {i}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        result.append(f"{name}.{count}" if count else name)
    return result


def _named_rows(spark: SparkSession, path: str, multi_line: bool, header_rows: int,
                names_of: Callable[[list[list[str | None]]], list[str]]) -> DataFrame:
    """Rows of all sheets at ``path`` with columns bound by each sheet's own header.

    ``names_of`` makes one name per column of the header rows; columns without a name are dropped.
    Sheets may order their columns differently; one with other names is an error. Adds ``source_file``
    and ``row_ordinal``, which counts from 0 below the header.
    """
    reader = _csv(spark, multi_line).option("header", False)
    first = reader.csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"no sheet at {path}")
    # one column more than the first sheet has shows a wider one
    raw = [f"c{i}" for i in range(len(first[0]) + 1)]
    rows = file_ordinals(reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in raw])).csv(path))
    in_header = F.col("row_ordinal") < header_rows
    cells = F.struct("row_ordinal", F.array(*raw).alias("cells"))
    heads = rows.filter(in_header).groupBy("source_file").agg(F.sort_array(F.collect_list(cells)).alias("head"))
    heads = heads.select("source_file", F.transform("head", lambda h: h["cells"]).alias("head"))
    kinds = heads.groupBy("head").agg(F.min("source_file").alias("file")).limit(MOST_HEADERS + 1).collect()
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers at {path}")
    kinds.sort(key=lambda k: k["file"])
    places: list[list[int]] = []
    names: list[str] = []
    for kind in kinds:
        if len(kind["head"]) < header_rows:
            raise ValueError(f"no header of {header_rows} rows in {kind['file']}")
        found = names_of([list(line) for line in kind["head"]])
        names = names or [n for n in found if n]
        if sorted(n for n in found if n) != sorted(names) or len(set(names)) < len(names):
            raise ValueError(f"the header of {kind['file']} differs from that of {kinds[0]['file']}")
        places.append([found.index(n) for n in names])
    body = rows.filter(~in_header)
    keep = ["source_file", (F.col("row_ordinal") - header_rows).alias("row_ordinal")]
    if len(kinds) == 1:
        return body.select(*[q(raw[i]).alias(n) for i, n in zip(places[0], names)], *keep)
    table = spark.createDataFrame([(k["head"], p) for k, p in zip(kinds, places)],
                                  "head array<array<string>>, places array<int>")
    own = heads.join(F.broadcast(table), "head").select("source_file", "places")  # MOST_HEADERS rows
    bound = lookup_join(body, own, ["source_file"], "inner", spread=["row_ordinal"])
    cells = F.array(*raw)
    return bound.select(*[F.get(cells, F.col("places")[i]).alias(n) for i, n in enumerate(names)], *keep)


def read_products_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Flat sheets with one header row: every column as text, plus ``source_file`` and ``row_ordinal``.

    Columns are bound by name in each sheet; a sheet with other names is an error. A repeated or blank
    header gets a name of its own (see ``unique_names``). With ``multi_line`` (cells that hold line
    breaks) each file is read by one task; without it files are split among tasks.
    """
    return _named_rows(spark, path, multi_line, 1, lambda head: _without_extra(
        unique_names([(c or "").lstrip("\ufeff") for c in head[0][:-1]]), head))


def _without_extra(names: list[str], head: list[list[str | None]]) -> list[str]:
    """Refuse a sheet that has a column more than the first one."""
    if any(line[-1] for line in head):
        raise ValueError("a sheet has more columns than the first one")
    return names


def flatten_header(tops: list[str | None], subs: list[str | None]) -> list[str]:
    """One name per column from two header rows; columns blank in both rows get an empty name.

    A column's group is its top cell. A top cell of white space alone takes the group to its left; an
    empty one has none. The name is the non-blank ones of group and sub cell.
    """
    groups = accumulate(tops, lambda left, top: left if top and not top.strip() else (top or "").strip(), initial="")
    pairs = zip(islice(groups, 1, None), subs)
    return [" ".join(filter(None, (group, (sub or "").strip()))) for group, sub in pairs]


def read_two_level_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Sheets with two header rows, flattened and bound by name; columns without any name are dropped.

    With ``multi_line`` each file is read by one task.
    """
    return _named_rows(spark, path, multi_line, 2, lambda head: _without_extra(
        flatten_header([(c or "").lstrip("\ufeff") for c in head[0][:-1]], head[1][:-1]), head))


def read_category_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Long sheets: category, item, value, plus ``source_file`` and ``row_ordinal``; bound by name.

    With ``multi_line`` each file is read by one task.
    """
    rows = read_products_csv(spark, path, multi_line)
    missing = [n for n in CATEGORY_SHEET.names if n not in rows.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing at {path}")
    return rows.select(*[q(n).alias(as_) for n, as_ in zip(CATEGORY_SHEET.names, ("category", "item", "value"))],
                       "source_file", "row_ordinal")
