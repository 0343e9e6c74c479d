"""Text functions as column expressions (all JVM-side)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.schema import ANSWER_MARKER, MISSING, STRING_MAP

# Fixed value: pattern of the header label a sheet reader gives to a blank header cell.
AUTO_LABEL = r"Unnamed: \d+_level_\d+"

# Fixed value: the instruction text put around a question and its context.
PROMPT = """
    You are a financial product expert and consultant who always responds in Korean.
    Your task is to analyze the user query and the given financial product data to recommend the most suitable financial product.

    ## User Query:
    {question}

    ## Financial Product Data:
    {context}

    ## Instructions:
    1. Use only the provided data. Do not add any information that is not present in the data.
    2. If you do not know the answer or the data is insufficient, respond with "모르겠습니다".
    3. Clearly extract and present the following format:
       - Bank Name
       - Product Name
       - Basic Interest Rate
       - Highest Interest Rate (including preferential rate)
       - Conditions/Restrictions
       - Recommendation Reason  
    4. Please provide your final answer after the tag [USER_ANSWER].

    ##[USER_ANSWER]:
    """


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Drop ``▷``, turn ``<br />`` into a space, collapse Unicode whitespace, trim."""
    plain = F.replace(F.replace(_col(c), F.lit("▷"), F.lit("")), F.lit("<br />"), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " "))


def strip_text(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def strip_auto_label(name: str) -> str:
    return re.sub(AUTO_LABEL, "", name).strip()


def tokens(c: Column | str) -> Column:
    """Split on single spaces, keeping empty tokens."""
    return F.split(_col(c), " ")


def line(name: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), _col(c))


def ellipsis(c: Column | str, n: int = 50) -> Column:
    c = _col(c)
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, F.lit("...")).otherwise(F.lit("")))


def doc_id(prefix: str | Column, ordinal: Column | str) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.format_string("%s_%03d", prefix, _col(ordinal))


def content_hash(c: Column | str) -> Column:
    return F.substring(F.sha1(_col(c)), 1, 20)


def meta_get(metadata: Column | str, key: str, default: Column | None = None) -> Column:
    value = F.try_element_at(_col(metadata), F.lit(key))
    return value if default is None else F.coalesce(value, default)


def doc_key(metadata: Column | str, content: Column | str) -> Column:
    """Identity of a document: its metadata id, else a hash of its content."""
    return meta_get(metadata, "id", content_hash(content))


def lexical_text(metadata: Column | str, content: Column | str) -> Column:
    return meta_get(metadata, "key_summary", _col(content))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)\z", 1)


def output_name(path: Column | str, extension: str = ".json") -> Column:
    """Base name of ``path`` with its last extension replaced."""
    root = F.regexp_replace(base_name(path), r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")
    return F.concat(root, F.lit(extension))


def metadata_from_json(c: Column | str) -> Column:
    """JSON object text to a string map; blank text gives an empty map."""
    c = _col(c)
    empty = F.create_map().cast(STRING_MAP)
    return F.when(strip_text(F.coalesce(c, F.lit(""))) == "", empty).otherwise(F.from_json(c, STRING_MAP))


def documents_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_xml(c: Column | str, schema: str) -> Column:
    return F.from_xml(_col(c), schema)


def page_count(total: Column | str, page_size: int) -> Column:
    return F.ceil(_col(total) / F.lit(page_size)).cast("long")


def extract_answer(c: Column | str, marker: str = ANSWER_MARKER) -> Column:
    """Text after the first marker, else the whole text; stripped."""
    c = _col(c)
    at = F.locate(marker, c)
    return strip_text(F.when(at > 0, F.substr(c, at + F.lit(len(marker)))).otherwise(c))


def build_prompt(question: Column | str, context: Column | str, template: str = PROMPT) -> Column:
    """Fill a template by concatenation, so braces inside the question or context stay as they are."""
    slots = {"{question}": _col(question), "{context}": _col(context)}
    parts = re.split(r"(\{question\}|\{context\})", template)
    return F.concat(*[slots.get(part, F.lit(part)) for part in parts])


def python_float(c: Column | str) -> Column:
    """Print a DOUBLE with the shortest digits and no exponent below 1e16: 2.70 -> 2.7, 1E7 -> 10000000.0."""
    text = _col(c).cast("string")
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+\z", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    exponent = F.regexp_extract(text, r"E(-?\d+)\z", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"\A([^E]*)E", 1), r"\.0\z", "")
    scientific = F.concat(mantissa, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
                          F.format_string("%02d", F.abs(exponent)))
    return (F.when(exponent.isNull(), text)
            .when(exponent.between(-4, 15), plain)
            .otherwise(scientific))


def present(c: Column | str) -> Column:
    """True for a cell that carries information."""
    trimmed = strip_text(c)
    return F.coalesce((trimmed != "") & (trimmed != MISSING), F.lit(False))
