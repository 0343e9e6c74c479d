"""Secret scans with multipart credential linking.

Three kinds are reported wherever they match (the base kinds): assignments of a secret-like name,
cloud access identifiers and long hexadecimal runs. Two kinds are weak on their own: a mixed-case
key-like run (``key``) and an address of a service (``endpoint``). They are reported only when
complementary parts co-occur in a scope: an identifier or assigned name or endpoint beside a key, and
an identifier or secret beside an endpoint. A scope is a stretch of ``reach`` code points around the
strong part; parts and scopes are joined as sorted intervals, so a text with many parts is not
compared pair by pair.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.words import slices

BASE_KINDS = ("assign", "access", "hex")
LINKED_KINDS = ("key", "endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken from its start, so shorter runs never match
KEY = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
ENDPOINT = re.compile(r"""(?:https?|s3|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[^\x20\x09-\x0D"'<>]+""")
# A text holding none of these in lower case holds no assignment.
NAMES = ("passw", "secret", "token", "api_key", "apikey")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    found = []
    lower = text.lower()
    if any(name in lower for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _is_key(run: str) -> bool:
    """A weak key: upper case, lower case and digits mixed."""
    return any(c.isupper() for c in run) and any(c.islower() for c in run) and any(c.isdigit() for c in run)


def _near(spans: list[tuple[int, int]], scopes: list[tuple[int, int]], reach: int) -> list[bool]:
    """For each span, whether some scope lies within ``reach``; an interval join on sorted ends.

    Spans of one list don't overlap each other; scopes may, so the latest end before a place is kept.
    """
    scopes = sorted(scopes)
    starts = [s for s, _ in scopes]
    latest = np.maximum.accumulate([e for _, e in scopes]).tolist() if scopes else []
    near = []
    for start, end in spans:
        n = bisect_left(starts, end + reach + 1)  # scopes that begin before the span's reach ends
        near.append(n > 0 and latest[n - 1] >= start - reach)
    return near


def find_spans(text: str, reach: int) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all reported spans of a text, sorted."""
    base = base_spans(text)
    addresses = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not base and not addresses:
        return []
    taken = [(s, e) for s, _, e in base]
    keys = [(m.start(), m.end()) for m in KEY.finditer(text) if _is_key(m.group())]
    covered = _near(keys, [(s, e - 1) for s, e in taken], -1)  # those that overlap a base span
    keys = [k for k, inside in zip(keys, covered) if not inside]
    strong = [(s, e) for s, kind, e in base if kind != 2]
    linked = [(s, 3, e) for (s, e), ok in zip(keys, _near(keys, strong + addresses, reach)) if ok]
    linked += [(s, 4, e) for (s, e), ok in zip(addresses, _near(addresses, taken + keys, reach)) if ok]
    return sorted(base + linked)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _spans(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    kinds = BASE_KINDS + LINKED_KINDS
    return pa.array([[{"kind": kinds[k], "start": s, "end": e} for s, k, e in f] for f in found], ARROW_SPANS)


def scan_secrets(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets of every whole text: ``doc_id, spans`` (kind, start, end in code points).

    ``spans`` is sorted by start, then by kind as listed; a null or empty text has none. Repeated rows are
    scanned each; a null id stays null; an empty table gives no rows. Other columns are not read. Rows
    stay where they are: no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            found = [find_spans(t or "", reach) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _spans(found)], ["doc_id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(scan, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)]))


def redact_secrets(docs: DataFrame, reach: int = 200, text_col: str = "text", length_col: str | None = None,
                   mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``, with ``mark`` in place of each stretch of reported spans.

    ``length_col`` names a column to set to the new number of code points. A null text stays null, an empty or
    blank one as it is; texts are searched whole, however long; spans that overlap or touch get one mark.
    Repeated rows are changed alike, ids play no part, and an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not (found := find_spans(t, reach)) else redact(t, found, mark)
                          for t in column], dtype=object)

    new = {text_col: clean(F.col(f"`{text_col}`"))}
    out = docs.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
    if length_col is None:
        return out
    size = F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType)
    return out.select(*[(size if c == length_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """Replace every stretch covered by spans."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"),
                                                                 s.end.cast("string"))), ",")
