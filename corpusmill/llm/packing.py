"""Cost-balanced packing of tokenised documents into fixed-size training sequences.

The cost of a piece of n tokens in a sequence is estimated as ``linear * n + quadratic * n * n``
(feed-forward work and attention work). Inside a block of documents, pieces are taken by descending
length and each goes to the sequence of lowest cost that still has room for it. A piece that no
sequence has room for is cut and its head fills the emptiest sequence. Each block's sequences hold
exactly the block's tokens: full sequences, and at the end of a partition the rest in sequences of
power-of-two sizes, which need no padding.

Documents are packed where they are: no shuffle, a bounded block at a time, so neither a long
document nor a large group of copies meets in one task beyond its input split. A lost task is redone
from its input split with the same result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import Codes, slices, texts_of

# Texts of these characters and ASCII blanks are lower-cased and cut into pre-tokens here. In other texts that is
# done between the chunks that hold other characters, which the tokenizer encodes as they are. All
# characters are single, composed code points with one lower-case form.
PLAIN = r"!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
BLANK = r"\x20\x09-\x0d"
PLAIN_TEXT = re.compile(f"[{PLAIN}{BLANK}]*")
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|"
                        rf"[^a-z0-9\u00df-\u00f6\u00f8-\u00ff{BLANK}]+")


class PieceTokenizer:
    """Token ids of whole texts, encoding each distinct pre-token once.

    Equal to encoding the whole text with a tokenizer that lower-cases, drops white space, cuts
    pre-tokens by the pattern above with letters and digits of any script, and ends the last token of
    each pre-token with a mark. Beyond ``remembered`` pre-tokens the less used half is forgotten.
    """

    def __init__(self, path: str, remembered: int = 200_000):
        self._tokenizer = tokenizers.Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._remembered = remembered
        self._codes = Codes()
        self._start, self._length, self._uses = (np.zeros(0, np.int64) for _ in range(3))
        self._ids = np.zeros(0, np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _runs(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens and their number for each, in one call; the end marks tell them apart."""
        ids = self._encode(" ".join(part))
        lengths = np.diff(np.flatnonzero(self._ends[ids]), prepend=-1)
        if len(lengths) == len(part) and lengths.sum() == len(ids):
            return ids, lengths
        runs = [self._encode(p) for p in part]
        return np.concatenate(runs), np.array([len(r) for r in runs], np.int64)

    def _learn(self) -> None:
        known = len(self._start)
        fresh = list(self._codes)[known:]
        runs = []
        for odd in (False, True):  # a whole chunk is marked by a blank before it
            mine = [i for i, p in enumerate(fresh) if p.startswith(" ") is odd]
            for a in range(0, len(mine), 1 if odd else 8192):
                part = mine[a:a + (1 if odd else 8192)]
                if odd:
                    ids = self._encode(fresh[part[0]][1:])
                    runs.append((part, ids, np.array([len(ids)])))
                else:
                    runs.append((part, *self._runs([fresh[i] for i in part])))
        start, length = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        used = len(self._ids)
        for part, ids, lengths in runs:
            start[part], length[part] = used + np.cumsum(lengths) - lengths, lengths
            used += len(ids)
        self._ids = np.concatenate([self._ids, *[ids for _, ids, _ in runs]])
        self._start, self._length = np.concatenate([self._start, start]), np.concatenate([self._length, length])
        self._uses = np.concatenate([self._uses, np.zeros(len(fresh), np.int64)])

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self._uses, kind="stable")[:self._remembered // 2])
        words = list(self._codes)
        self._codes = Codes((words[i], j) for j, i in enumerate(kept.tolist()))
        self._ids = self._gathered(kept)
        self._length, self._uses = self._length[kept], self._uses[kept] // 2
        self._start = np.cumsum(self._length) - self._length

    def _gathered(self, codes: np.ndarray) -> np.ndarray:
        lengths = self._length[codes]
        before = np.cumsum(lengths) - lengths
        return self._ids[np.repeat(self._start[codes] - before, lengths) + np.arange(int(lengths.sum()))]

    def _pre_tokens(self, text: str) -> list[str]:
        if "<|" not in text and PLAIN_TEXT.fullmatch(text):
            return PRE_TOKENS.findall(text.lower())
        out = []
        for chunk in text.encode().split():  # at ASCII blanks
            chunk = chunk.decode()
            out += (PRE_TOKENS.findall(chunk.lower()) if "<|" not in chunk and PLAIN_TEXT.fullmatch(chunk)
                    else [" " + chunk])
        return out

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self._codes) > self._remembered:
            self._forget()
        number = self._codes.__getitem__
        runs = []
        for text in texts:
            pieces = self._pre_tokens(text.decode())
            runs.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if len(self._codes) > len(self._start):
            self._learn()
        self._uses += np.bincount(np.concatenate(runs), minlength=len(self._uses)) if runs else 0
        return [self._gathered(codes) for codes in runs]


def assign(lengths: list[int], sizes: list[int], linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """Deal pieces of the given lengths to sequences of the given sizes; both sum to the same.

    Returns per sequence its (piece, start in the piece, length, offset in the sequence).
    """
    free = np.array(sizes, np.int64)
    cost = np.zeros(len(sizes))
    held: list[list[tuple[int, int, int, int]]] = [[] for _ in sizes]
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)  # a cut piece's rest goes back by its own length
    while queue:
        n, piece, start = heapq.heappop(queue)
        n = -n
        fits = free >= n
        if fits.any():
            at, take = int(np.argmin(np.where(fits, cost, np.inf))), n
        else:  # cut: the head fills the sequence with most room, the cheaper one of equals
            most = free.max()
            at, take = int(np.argmin(np.where(free == most, cost, np.inf))), int(most)
            heapq.heappush(queue, (take - n, piece, start + take))
        held[at].append((piece, start, take, sizes[at] - int(free[at])))
        free[at] -= take
        cost[at] += linear * take + quadratic * take * take
    return held


def power_sizes(rest: int) -> list[int]:
    """Powers of two that sum to ``rest``, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0,
                   quadratic: float = 1.0 / 2048, block_tokens: int = 1 << 19, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and pack them into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.
    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers, ``start`` counts
    the document's ids before the piece, and a sequence's pieces have gapless offsets from 0.
    Sequences hold ``capacity`` ids, or a smaller power of two at the end of a partition.

    A null or empty text is the end id alone; repeated rows are packed each; a text longer than a
    sequence is cut; equal lengths keep their input order; an empty table gives no rows. A null id
    stays null. Other columns are not read. ``block_tokens`` bounds memory, not the output's padding.
    """
    block = max(block_tokens // capacity, 1) * capacity
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                        ("ids", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = PieceTokenizer(tokenizer)  # freed after the task
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        waiting: list[tuple[object, int, int, np.ndarray]] = []  # (id, ids before, document's ids, ids)
        tokens = 0

        def emit(pieces, sizes):
            nonlocal sequence
            columns: list[list] = [[] for _ in schema]
            for held in assign([len(p[3]) for p in pieces], sizes, linear, quadratic):
                for piece, start, length, offset in held:
                    doc, before, total, ids = pieces[piece]
                    row = (doc, before + start, length, total, sequence, offset, ids[start:start + length].tobytes())
                    for column, value in zip(columns, row):
                        column.append(value)
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        end = np.array([end_id], np.uint32)
        for rows in slices(batches, "text"):
            for doc, ids in zip(rows.column("id").to_pylist(), encode(texts_of(rows.column("text")))):
                ids = np.concatenate([ids, end]).astype("<u4")
                total = len(ids)
                for a in range(0, total, capacity):  # a document's full sequences, then its rest
                    piece, room = ids[a:a + capacity], block - tokens
                    if len(piece) >= room:  # the block is full to the token
                        yield emit([*waiting, (doc, a, total, piece[:room])], [capacity] * (block // capacity))
                        waiting, tokens, a, piece = [], 0, a + room, piece[room:]
                    if len(piece):
                        waiting.append((doc, a, total, piece))
                        tokens += len(piece)
        if waiting:
            yield emit(waiting, [capacity] * (tokens // capacity) + power_sizes(tokens % capacity))

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(pack, "doc_id long, start long, length long, doc_tokens long, sequence_id long, "
                                   "offset long, ids binary")
