"""Token counts of fields and sections by offset mapping.

A record's fields are joined into one text and tokenised once as a whole. Token spans in code points
are joined to the spans of sections (fields, and the lines of the last field) as sorted intervals. A
token that crosses a boundary is allocated by a rule:

- ``majority``: to the section that holds most of its code points, the earlier one of equals;
- ``start``: to the section that holds its first code point, or else the next one it touches;
- ``split``: to all sections it touches, in proportion to its code points in them.

Code points between sections (separators) are nobody's: they don't count for any rule, and a token
that touches no section is counted as ``(between)``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import slices, texts_of

RULES = ("majority", "start", "split")
BETWEEN = "(between)"


class OffsetTokenizer:
    """Token spans of a whole text, in code points, from the byte lengths of its tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                           special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._bytes[rank] = len(token)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends. A token inside a code point has that code point's span."""
        ids = np.array(self._encoding.encode_ordinary(text.decode()), np.int64)
        ends = np.cumsum(self._bytes[ids])
        begun = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        start, end = begun[ends - self._bytes[ids]], begun[ends]
        return ids, np.minimum(start, end - 1), end


@lru_cache(maxsize=2)
def offset_tokenizer(path: str) -> OffsetTokenizer:
    return OffsetTokenizer(path)


def allocate(start: np.ndarray, end: np.ndarray, section_start: np.ndarray, section_end: np.ndarray,
             rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Join sorted token spans to sorted sections that don't overlap.

    Returns (token, section, share) of each allocation and, per token, the number of sections it touches.
    """
    first = np.searchsorted(section_end, start, side="right")
    last = np.searchsorted(section_start, end, side="left")
    touched = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(start)), touched)
    section = np.arange(len(token)) - np.repeat(np.cumsum(touched) - touched, touched) + np.repeat(first, touched)
    common = (np.minimum(end[token], section_end[section]) - np.maximum(start[token], section_start[section]))
    real = common > 0  # empty sections hold nothing
    token, section, common = token[real], section[real], common[real]
    touched = np.bincount(token, minlength=len(start))
    if rule == "split":
        whole = np.bincount(token, common, minlength=len(start))
        return token, section, common / whole[token], touched
    if rule == "start":
        pick = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    else:
        order = np.lexsort((section, -common, token))
        pick = np.zeros(len(token), bool)
        if len(order):
            pick[order[np.concatenate([[True], np.diff(token[order]) != 0])]] = True
    return token[pick], section[pick], np.ones(int(pick.sum())), touched


def sections_of(fields: list[str], names: list[str], separator: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, starts and ends of a record's sections: each field, the last one line by line.

    A line holds the line feed that ends it.
    """
    labels, starts, ends, at = [], [], [], 0
    for i, (name, value) in enumerate(zip(names, fields)):
        parts = value.split("\n") if i == len(fields) - 1 else [value]
        for j, part in enumerate(parts):
            size = len(part) + (j < len(parts) - 1)
            if j < len(parts) - 1 or size or len(parts) == 1:
                labels.append(name)
                starts.append(at)
                ends.append(at + size)
            at += size
        at += len(separator)
    return labels, np.array(starts, np.int64), np.array(ends, np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("source", "lang", "text"),
                 separator: str = " ", rule: str = "majority", id_col: str = "doc_id") -> DataFrame:
    """One row per section of each record: ``doc_id, section, field, start, end, tokens, crossing``.

    ``section`` counts from 0; ``start`` and ``end`` are code points of the joined record; ``tokens`` is
    the sum of the tokens allocated to the section (a whole number unless the rule is ``split``), and
    ``crossing`` how many of the tokens allocated to it, wholly or in part, also hold code points outside
    the section. Tokens that touch no section are a row of their own with section -1 and field
    ``(between)``, if there are any; so a record's tokens sum to its number of tokens.

    Null fields are empty; an empty field is a section without tokens; repeated rows are counted each; a
    null id stays null; an empty table gives no rows. Fields are read by name and other columns not at
    all. Rows stay where they are: no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("field", pa.string()), ("start", pa.int64()),
                        ("end", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = offset_tokenizer(tokenizer)
        for part in slices(batches, f"f{len(fields) - 1}"):
            values = [[t.decode() for t in texts_of(part.column(f"f{i}"))] for i in range(len(fields))]
            out: list[list] = [[] for _ in schema]
            for doc, *record in zip(part.column("id").to_pylist(), *values):
                labels, starts, ends = sections_of(record, list(fields), separator)
                ids, begin, stop = encode(separator.join(record).encode())
                token, section, share, touched = allocate(begin, stop, starts, ends, rule)
                tokens = np.bincount(section, share, minlength=len(labels))
                outside = (begin[token] < starts[section]) | (stop[token] > ends[section])
                crossing = np.bincount(section[outside], minlength=len(labels))
                columns = [[doc] * len(labels), range(len(labels)), labels, starts.tolist(), ends.tolist(),
                           tokens.tolist(), crossing.tolist()]
                for column, more in zip(out, columns):
                    column.extend(more)
                between = int((touched == 0).sum())
                if between:
                    for column, value in zip(out, (doc, -1, BETWEEN, 0, int(stop[-1]), float(between), 0)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("id"),
                         *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return source.mapInArrow(count, "doc_id long, section int, field string, start long, end long, tokens double, "
                                    "crossing long")
