"""N-gram Jaccard join of whole texts by MinHash banding, with exact verification.

1. Every text becomes its set of word 5-grams. Texts with the same set form a class (copies).
2. Each class gets MinHash values cut into bands; classes equal in a band share a bucket. Bands and
   rows follow from the similarity and a target recall.
3. Buckets are counted on narrow rows. Those of one class go, and of buckets with the same members
   one is kept. The texts of classes in the kept buckets are read again and sent there.
4. A bucket is verified on the full n-gram sets. A large one is cut into blocks of bounded size and
   every pair of blocks is a task of its own. A pair of classes counts in its first common bucket
   only. No pairs leave the task: each class reports its number of links and one edge to the
   smallest class it is connected with there.
5. Connected classes get one group id.

Work on a hot group of different texts grows with the pairs that are compared, as every link is
verified; the rows that travel grow with the group's size only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.words import WordTable, mix, packed, shingles, slices, starts_of, texts_of, word_hashes
from corpusmill.runtime import lookup_join, stored

# A block of a bucket holds at most so many classes and about so many n-grams.
BLOCK_CLASSES = 512
BLOCK_GRAMS = 400_000
# Cells of one incidence matrix.
MATRIX_CELLS = 4 << 20


def choose_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): most rows, so fewest chance candidates, that reach ``recall`` at ``threshold``."""
    best = None
    for rows in range(1, max_hashes + 1):
        chance = threshold ** rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so many hashes")
    return best


class Signer:
    """Set hash, set size and band hashes of texts."""

    def __init__(self, n: int, bands: int, rows: int, seed: int = 20):
        self._words, self._n, self._bands, self._rows = WordTable(word_hashes), n, bands, rows
        random = np.random.default_rng(seed)
        self._flip = random.integers(0, 1 << 32, bands * rows, np.uint32)
        self._times = random.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        self._weights = random.integers(0, 1 << 63, bands * rows, np.uint64) | np.uint64(1)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        hashes, counts = shingles(*self._words(texts), self._n)
        return [np.unique(hashes[a:a + c]) for a, c in zip(starts_of(counts), counts)]

    def __call__(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """The n-gram sets, and band hashes as a matrix (zeros for an empty set)."""
        sets = self.sets(texts)
        counts = np.array([len(s) for s in sets], np.int64)
        bands = np.zeros((len(sets), self._bands), np.int64)
        filled = np.flatnonzero(counts)
        if len(filled):
            at = starts_of(counts[filled])
            narrow = (np.concatenate([sets[i] for i in filled]) >> np.uint64(32)).astype(np.uint32)
            room = np.empty_like(narrow)
            least = np.empty((self._bands * self._rows, len(filled)), np.uint64)
            for j, (flip, times) in enumerate(zip(self._flip, self._times)):
                np.bitwise_xor(narrow, flip, out=room)
                np.multiply(room, times, out=room)
                least[j] = np.minimum.reduceat(room, at)
            with np.errstate(over="ignore"):
                least = mix(least + np.uint64(1)) * self._weights[:, None]
                folded = least.reshape(self._bands, self._rows, -1).sum(axis=1, dtype=np.uint64)
                bands[filled] = mix(folded).T.view(np.int64)
        return sets, bands


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, mark, grams, n_grams, bands`` per row; ``mark`` is a hash of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("grams", pa.binary()),
                        ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n, bands, rows)
        for part in slices(batches, "text", 1 << 20):
            sets, hashes = signer(texts_of(part.column("text")))
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("mark"),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(hashes.ravel()))], schema=schema)

    return docs.mapInArrow(sign, "doc_id long, mark long, grams binary, n_grams long, bands array<long>")


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Matrix of whether sets of ``left`` and ``right`` (or ``left`` again) reach the similarity.

    Intersections come from incidence matrices over the n-grams that occur more than once, a bounded
    number of n-grams at a time.
    """
    sets = left if right is None else left + right
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    gram = np.cumsum(fresh) - 1
    often = np.bincount(gram)[gram] > 1
    gram, owner = gram[often], owner[often]
    if len(gram):
        gram = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
    a = len(left)
    common = np.zeros((a, a if right is None else len(right)), np.int64)
    width = max(MATRIX_CELLS // len(sets), 1)
    total = int(gram[-1]) + 1 if len(gram) else 0
    for low in range(0, total, width):
        i, j = np.searchsorted(gram, [low, low + width])
        cells = np.zeros((len(sets), min(width, total - low)), np.float32)
        cells[owner[i:j], gram[i:j] - low] = 1
        common += (cells[:a] @ (cells.T if right is None else cells[a:].T)).astype(np.int64)
    union = sizes[:a, None] + (sizes if right is None else sizes[a:])[None, :] - common
    return common / union >= threshold


def roots_of(linked: np.ndarray) -> np.ndarray:
    """Smallest index each row is connected with in a symmetric link matrix."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(root)).min(axis=1)
        nearer = np.minimum(root, least)
        nearer = nearer[nearer]
        if (nearer == root).all():
            return root
        root = nearer


def verify_cells(n: int, threshold: float):
    """Arrow function over rows sorted by (bucket, x, y): links and a local root for each class."""
    schema = pa.schema([("class", pa.binary()), ("links", pa.int64()), ("texts", pa.int64()), ("root", pa.binary())])
    columns = ["bucket", "x", "y", "block", "band", "class", "copies", "buckets", "text"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n, 1, 1)

        def check(cell: list[tuple]):
            _, x, y, _, band, *_ = cell[0]
            cell.sort(key=lambda r: (r[3] != x, r[5]))
            first = sum(r[3] == x for r in cell)
            sets = signer.sets([r[8].encode() for r in cell])
            shared = [{b["band"]: b["bucket"] for b in r[7]} for r in cell]
            owned = np.array([[s.get(b, 0) for b in range(band + 1)] for s in shared], np.int64)
            copies = np.array([r[6] for r in cell], np.int64)
            one = x == y
            a, b = (owned, owned) if one else (owned[:first], owned[first:])
            if not len(a) or not len(b):
                return
            linked = links_between(sets, None, threshold) if one else links_between(sets[:first], sets[first:],
                                                                                    threshold)
            for i in range(band):  # the pair belongs to an earlier bucket
                linked &= ~((a[:, i, None] == b[None, :, i]) & (a[:, i, None] != 0))
            if one:
                np.fill_diagonal(linked, False)
                whole = linked
            else:
                whole = np.zeros((len(cell), len(cell)), bool)
                whole[:first, first:] = linked
                whole[first:, :first] = linked.T
            texts = whole.sum(axis=1)
            links = whole @ copies
            root = roots_of(whole)
            some = np.flatnonzero(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([cell[i][5] for i in some], pa.binary()), pa.array(links[some], pa.int64()),
                pa.array(texts[some], pa.int64()), pa.array([cell[root[i]][5] for i in some], pa.binary())],
                schema=schema)

        cell: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in columns]):
                if cell and cell[-1][:3] != row[:3]:
                    yield from check(cell)
                    cell = []
                cell.append(row)
        if cell:
            yield from check(cell)

    return verify


def _groups(docs: DataFrame, n: int, threshold: float, recall: float, id_col: str, text_col: str,
            block_classes: int, block_grams: int) -> DataFrame:
    """The columns of ``near_duplicates`` and ``label``, which names the group without its ids."""
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.xxhash64(text_col).alias("mark"))
    signed = stored(signatures(source, n, bands, rows), "ngram-signatures")
    classes = stored(signed.groupBy("grams").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"),
        F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")),
        "ngram-classes")

    members = classes.filter("n_grams > 0").select("grams", "n_grams", F.posexplode("bands").alias("band", "bucket"))
    buckets = (members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("all_grams"), F.min("band").alias("band"),
        F.bit_xor(F.xxhash64("grams")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "grams")).alias("x2"))
        .filter("n > 1"))
    kept = stored(buckets.groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "bucket", "all_grams")).alias("b"))
                  .select(F.col("b.bucket"), F.greatest(F.ceil(F.col("n") / block_classes),
                                                        F.ceil(F.col("b.all_grams") / block_grams)).alias("blocks")),
                  "ngram-buckets")
    placed = stored(lookup_join(members, kept, ["bucket"], spread=["grams"]).drop("n_grams"), "ngram-members")

    wanted = placed.groupBy("grams").agg(F.collect_list(F.struct("band", "bucket")).alias("buckets"))
    texts = wanted.join(classes.select("grams", "copies", "first.doc_id", "first.mark"), "grams")
    texts = source.alias("s").join(texts.alias("t"), (F.col("s.mark") == F.col("t.mark"))
                                   & F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")))
    # rows repeated in full stand for one class and count once
    texts = texts.select("t.grams", "t.copies", "t.buckets", "s.text").dropDuplicates(["grams"])
    sent = texts.join(placed, "grams")
    block = F.pmod(F.xxhash64(F.lit(2), "grams"), F.col("blocks"))
    cells = (sent.withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                     "block", "band", F.col("grams").alias("class"), "copies", "buckets", "text"))
    cell = ["bucket", "x", "y"]
    checked = stored(cells.repartition(*cell).sortWithinPartitions(*cell)
                     .mapInArrow(verify_cells(n, threshold), "class binary, links long, texts long, root binary"),
                     "ngram-links")

    links = checked.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(checked.filter("class != root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    known = (classes.select("grams", "copies", F.col("first.doc_id").alias("copy_id"))
             .join(links.withColumnRenamed("class", "grams"), "grams", "left")
             .join(groups.withColumnRenamed("node", "grams"), "grams", "left")
             .withColumn("label", F.coalesce("label", "grams")))
    least = (known.filter(F.col("links").isNotNull()).groupBy("label")
             .agg(F.min("copy_id").alias("class_id")))
    # classes of one row without links need no look-up
    more = stored(known.filter("copies > 1 or links is not null").join(least, "label", "left")
                  .select("grams", "label", F.coalesce("class_id", "copy_id").alias("class_id"), "copy_id", "copies",
                          F.coalesce("links", F.lit(0)).alias("links")), "ngram-groups")
    found = lookup_join(signed.select("doc_id", "mark", "grams"), more, ["grams"], "left", spread=["doc_id", "mark"])
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
                        F.coalesce("copy_id", "doc_id").alias("copy_id"),
                        F.coalesce("copies", F.lit(1)).alias("n_copies"), "mark",
                        F.coalesce("label", "grams").alias("label"))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999,
                    id_col: str = "doc_id", text_col: str = "text", block_classes: int = BLOCK_CLASSES,
                    block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, copy_id, n_copies, mark``.

    ``n_links`` is the number of other rows whose set of word n-grams has a Jaccard similarity of
    ``threshold`` or more with this row's; ``class_id`` is the smallest id among the rows connected by
    such links; ``copy_id`` and ``n_copies`` are the smallest id and number of the rows with the same
    set. ``mark`` is a hash of the text, to tell rows of one id apart.

    Words are runs of characters other than ASCII blanks, compared as they are. A text of fewer than n
    words is one n-gram. Null, empty and blank texts have the empty set and are copies of each other,
    linked to nothing else. Repeated rows are copies. Null ids are passed over when the smallest id
    is taken. An empty table gives no rows. Other columns are not read. Pairs at the threshold are
    found with probability ``recall`` or more, others with more; those found are exact.
    """
    return _groups(docs, n, threshold, recall, id_col, text_col, block_classes, block_grams).drop("label")


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the row with the smallest id.

    Groups are those of ``near_duplicates``; a null id comes after all others, and of rows with one id
    in a group the one with the smaller text hash stays. All columns are kept.
    """
    groups = _groups(docs, n, threshold, recall, id_col, text_col, BLOCK_CLASSES, BLOCK_GRAMS)
    rows = stored(groups.groupBy("label", F.col("doc_id").isNull().alias("none"),
                                 F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
                  .agg(F.count(F.lit(1)).alias("n")), "ngram-rows")
    key = ["none", "id", "mark"]
    best = rows.groupBy("label").agg(F.min(F.struct(*key)).alias("best")).select("label", "best.*")
    dropped = stored(rows.join(best, ["label", *key], "left_anti").select(*key), "ngram-dropped")
    keyed = packed(docs, none=F.col(id_col).isNull(), id=F.coalesce(F.col(id_col).cast("long"), F.lit(0)),
                   mark=F.xxhash64(text_col))
    kept = lookup_join(keyed, dropped, key, "left_anti", spread=["mark"])
    repeated = rows.filter("n > 1").select(*key)
    if repeated.isEmpty():
        return kept.select("doc.*")
    # rows repeated in full: one of them stays
    once = kept.join(repeated, key, "left_anti")
    many = kept.join(repeated, key, "left_semi").dropDuplicates(key)
    return once.unionByName(many).select("doc.*")
