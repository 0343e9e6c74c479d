"""Set similarity join by chosen paths: randomised trees over minwise tokens, exact links, components.

1. Every text becomes its set of word 3-grams; texts with equal sets form a class. Each class has
   ``HASHES`` minwise values, as two bytes each for paths and one byte each for sketches.
2. Each tree starts with all classes at its root. A node chooses one or two of the values by a hash of its
   path, 1.3 on average, and sends each class to the child named by the class's value (Christiani and
   Pagh 2017). Two sets of similarity s meet in a chosen child with probability s, so above 1/1.3 their
   common paths don't die out; ``tree_recall`` gives the share of trees that keep a pair together for
   ever, and the number of trees follows from a target recall. So nodes may branch several levels at a
   time, and only then are they counted.
3. Nodes of one class go, and of small nodes with the same members one is kept. Small nodes are compared
   exhaustively: by sketch first, whose bound loses a pair with probability 1e-6, then on full sets. What
   is alike by sketch goes on under a fingerprint of its members, so a group that many nodes find is
   verified once.
4. Large nodes are first compared by sketch with one of their sets, the pivot. If many may be linked to it,
   these are verified. Sets linked to the pivot are one component, so pairs among them need no comparison.
   A set y can only be linked to one of them if its similarity with the pivot is 2 * threshold - 1 or more, as
   1 - Jaccard is a metric; those are compared with them in blocks. All other sets branch on.
5. Linked classes are joined to components by their smallest id.

Rows that travel grow in proportion to classes, but for the sets in the shell around a hot pivot.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.words import WordTable, mix, shingles, slices, starts_of, texts_of, word_hashes
from corpusmill.runtime import lookup_join, stored

HASHES = 128
# Share of nodes that choose two values; the others choose one.
TWO = 0.3
# A node is small up to so many sets with so many n-grams in all; so few sets are small whatever their size.
SMALL_SETS = 1024
SMALL_GRAMS = 4_000_000
FEW_SETS = 4
# Levels that nodes branch before they are counted, from the root and then each time.
FIRST_LEVELS = 3
MORE_LEVELS = 4
# After so many counts large nodes are compared in pairs of blocks.
MOST_COUNTS = 24
# A node is dense if so large a share of it may be linked to its pivot.
DENSE = 0.1
PIVOT_BLOCK = 128
SKETCH_SIGMAS = 4.75
# Sketch pairs and cells of an incidence matrix held at once.
PAIRS = 1 << 17
MATRIX_CELLS = 4 << 20


def tree_recall(similarity: float, two: float = TWO) -> float:
    """Probability that two sets share a path of any length in one tree; 0 if their paths die out."""
    q = 1.0
    for _ in range(10_000):
        q = (1 - two) * similarity * q + two * (1 - (1 - similarity * q) ** 2)
    return q


def choose_trees(threshold: float, recall: float, two: float = TWO) -> int:
    kept = tree_recall(threshold, two)
    if kept < 0.01:
        raise ValueError("paths of pairs at this threshold die out")
    return math.ceil(math.log(1 - recall) / math.log1p(-kept))


def sketch_bound(threshold: float) -> int:
    """Equal sketch values that a linked pair has but for a probability of 1e-6."""
    return math.floor(HASHES * threshold - SKETCH_SIGMAS * math.sqrt(HASHES * threshold * (1 - threshold)))


class Sets:
    """N-gram sets of texts as sorted hashes, and their minwise values."""

    def __init__(self, n: int, seed: int = 11):
        self._words, self._n = WordTable(word_hashes), n
        random = np.random.default_rng(seed)
        self._flip = random.integers(0, 1 << 32, HASHES, np.uint32)
        self._times = random.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        hashes, counts = shingles(*self._words([t.lower() for t in texts]), self._n)  # bytes: A-Z only
        return [np.unique(hashes[a:a + c]) for a, c in zip(starts_of(counts), counts)]

    def minwise(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of hashed minima per set; zeros for an empty one."""
        counts = np.array([len(s) for s in sets], np.int64)
        out = np.zeros((len(sets), HASHES), np.uint64)
        filled = np.flatnonzero(counts)
        if len(filled):
            at = starts_of(counts[filled])
            narrow = (np.concatenate([sets[i] for i in filled]) >> np.uint64(32)).astype(np.uint32)
            room = np.empty_like(narrow)
            for j in range(HASHES):
                np.bitwise_xor(narrow, self._flip[j], out=room)
                np.multiply(room, self._times[j], out=room)
                out[filled, j] = np.minimum.reduceat(room, at)
            with np.errstate(over="ignore"):
                out[filled] = mix(out[filled] + np.uint64(1))
        return out


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, mark, grams, n_grams, path_values, sketch``: ``mark`` hashes the text, ``grams`` the set."""
    columns = [("doc_id", pa.int64()), ("mark", pa.int64()), ("grams", pa.binary()), ("n_grams", pa.int64()),
               ("path_values", pa.binary()), ("sketch", pa.binary())]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of = Sets(n)
        for part in slices(batches, "text", 1 << 20):
            sets = sets_of(texts_of(part.column("text")))
            values = sets_of.minwise(sets)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("mark"),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([r.tobytes() for r in values.astype("<u2")], pa.binary()),
                pa.array([r.tobytes() for r in (values >> np.uint64(32)).astype(np.uint8)], pa.binary())],
                schema=pa.schema(columns))

    return docs.mapInArrow(sign, "doc_id long, mark long, grams binary, n_grams long, path_values binary, sketch binary")


# --- trees ----------------------------------------------------------------------------------------


def _branch(root: bool) -> Callable[[Column], Column]:
    return lambda path: _chosen(path, root)


def _chosen(path: Column, root: bool) -> Column:
    """Paths of the children that a class goes to from a node, as an array."""
    first = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(HASHES))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(path, F.lit(2)), F.lit(HASHES - 1)), F.lit(HASHES))
    if root:  # trees differ in their first values
        first, second = F.pmod(2 * path, F.lit(HASHES)), F.pmod(2 * path + 1, F.lit(HASHES))

    def child(at: Column) -> Column:
        value = F.substring("path_values", (2 * at + 1).cast("int"), F.lit(2))
        return F.xxhash64(path, at, value)

    both = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(1000)) < int(1000 * TWO)
    return F.when(both, F.array(child(first), child(second))).otherwise(F.array(child(first)))


def _descend(rows: DataFrame, start: Column, root: bool, levels: int) -> DataFrame:
    """``path, grams, n_grams`` of the nodes that rows reach from the nodes ``start`` after some levels."""
    paths = start
    for level in range(levels):
        paths = F.flatten(F.transform(paths, _branch(root and level == 0)))
    return rows.select(F.explode(paths).alias("path"), "grams", "n_grams")


def _counted(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of nodes with more than one class, and whether the node is ``small``; small ones with new members only."""
    own = [F.bit_xor(F.xxhash64(F.lit(i), "grams")).alias(f"x{i}") for i in (1, 2)]
    nodes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("weight"), *own).filter("n > 1")
    small = (F.col("n") <= FEW_SETS) | (F.col("n") <= limit) & (F.col("weight") <= SMALL_GRAMS)
    members = [F.when(small, F.col(f"x{i}")).otherwise(F.xxhash64(F.lit(i), "path")).alias(f"x{i}") for i in (1, 2)]
    kept = stored(nodes.select("path", "n", small.alias("small"), *members).groupBy("n", "small", "x1", "x2")
                  .agg(F.min("path").alias("path")).select("path", "small"), "path-nodes")
    return stored(lookup_join(rows, kept, ["path"], spread=["grams"]).select("path", "grams", "n_grams", "small"),
                  "path-members")


def _in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches cut again so that rows with equal keys stay together, in pieces of about a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [np.asarray(batch.column(k)) for k in keys]
        differs = np.flatnonzero(reduce(np.logical_or, [c != c[-1] for c in last]))
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(differs):
            cut = int(differs[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place each of ``n`` is connected with by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _alike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Members of small nodes whose sketches agree in ``least`` places with another's, by connected group.

    A group is named by two sums of its members' hashes and is the same whichever node it was found in.
    """
    for table in _in_groups(batches, ["path"]):
        path = table.column("path").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(path), HASHES)
        ids = np.frombuffer(b"".join(table.column("grams").to_pylist()), np.uint64).reshape(len(path), 2)
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        sizes = np.diff(np.append(starts, len(path)))
        # row i meets the rows after it in its node
        after = np.repeat(starts + sizes, sizes) - np.arange(len(path)) - 1
        ends = np.cumsum(after)
        found = []
        low = 0
        while low < len(path):
            high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")), low + 1)
            many = after[low:high]
            a = np.repeat(np.arange(low, high), many)
            b = a + 1 + np.arange(len(a)) - np.repeat(starts_of(many), many)
            same = (sketch[a] == sketch[b]).sum(axis=1) >= least
            found.append((a[same], b[same]))
            low = high
        a, b = (np.concatenate(x) for x in zip(*found))
        label = least_labels(len(path), a, b)
        some = np.unique(np.concatenate([a, b]))
        if not len(some):
            continue
        group = np.unique(label[some], return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
        with np.errstate(over="ignore"):
            names = [np.add.reduceat(mix(ids[some[order], j]), cuts).view(np.int64)[group] for j in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[0]), pa.array(names[1]), table.column("grams").combine_chunks().take(pa.array(some))],
            ["x", "y", "grams"])


# --- verification ---------------------------------------------------------------------------------


def common_grams(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from incidence matrices over a bounded number of n-grams at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    gram = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    shared = np.bincount(gram)[gram] > 1 if len(gram) else np.zeros(0, bool)
    gram, owner = np.unique(gram[shared], return_inverse=True)[1], owner[shared]
    out = np.zeros((len(sets), len(sets)), np.int64)
    width = max(MATRIX_CELLS // len(sets), 1)
    for low in range(0, int(gram.max(initial=-1)) + 1, width):
        i, j = np.searchsorted(gram, [low, low + width])
        cells = np.zeros((len(sets), int(gram[j - 1]) - low + 1), np.float32)
        cells[owner[i:j], gram[i:j] - low] = 1
        out += (cells @ cells.T).astype(np.int64)
    return out


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of whether two sets have 100 * intersection >= percent * union; the empty set has no links."""
    common = common_grams(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    linked = (100 + percent) * common >= percent * (sizes[:, None] + sizes[None, :])
    linked &= common > 0
    np.fill_diagonal(linked, False)
    return linked


def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """An edge to the least member it is connected with for each class of a cell, on full sets.

    A cell is its classes compared with each other, or those of one side with the other's.
    """
    sets_of = Sets(n)
    for table in _in_groups(batches, ["x", "y"]):
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        for low, high in zip(starts, [*starts[1:], len(x)]):
            cell = table.slice(low, high - low).combine_chunks()
            sets = sets_of(texts_of(cell.column("text").combine_chunks()))
            linked = linked_pairs(sets, percent)
            side = cell.column("side").to_numpy()
            if side.any():
                linked &= side[:, None] != side[None, :]
            a, b = np.nonzero(np.triu(linked))
            label = least_labels(len(sets), a, b)
            moved = np.flatnonzero(label != np.arange(len(sets)))
            grams = cell.column("grams").combine_chunks()
            yield pa.RecordBatch.from_arrays([grams.take(pa.array(moved)), grams.take(pa.array(label[moved]))],
                                             ["a", "b"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of equal places of two sketches."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES)
                for c in ("sketch", "other"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("grams"), batch.column("pivot"), pa.array((a == b).sum(axis=1), pa.int32())],
            ["path", "grams", "pivot", "agree"])


def _against_pivot(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The sets linked to the pivot, which comes first in its block."""
    sets_of = Sets(n)
    key, pivot = None, None
    for batch in slices(batches, "text", 1 << 20):
        sets = sets_of(texts_of(batch.column("text")))
        out = []
        for own, name, block, first, grams in zip(
                sets, *[batch.column(c).to_pylist() for c in ("pivot", "block", "first", "grams")]):
            if (name, block) != key:
                key, pivot = (name, block), own
            common = len(np.intersect1d(own, pivot, assume_unique=True))
            if not first and 100 * common >= percent * (len(own) + len(pivot) - common):
                out.append((name, grams))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)],
                                         ["pivot", "grams"])


class _Texts:
    """Looks up the text of a class by the first of its documents."""

    def __init__(self, source: DataFrame, classes: DataFrame):
        self._source = source.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})
        self._classes = classes

    def join(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the column ``text`` of their class ``grams``."""
        wanted = stored(self._classes.select("grams", "first.*").join(rows.select("grams").distinct(), "grams"),
                        "path-wanted")
        keys = ["mark", "none", "id"]
        found = lookup_join(self._source.select(*keys, "text"), wanted, keys, spread=["id"])
        return rows.join(found.select("grams", "text").dropDuplicates(["grams"]), "grams")


def _block(rows: Column, size: int) -> Column:
    return F.greatest(F.ceil(rows / size), F.lit(1))


def _sides(left: DataFrame, right: DataFrame, limit: int) -> DataFrame:
    """Cells that compare each block of ``left`` with each block of ``right`` of one path."""
    counts = (left.groupBy("path").agg(F.count(F.lit(1)).alias("l"))
              .join(right.groupBy("path").agg(F.count(F.lit(1)).alias("r")), "path"))
    blocks = stored(counts.select("path", _block(F.col("l"), limit).alias("l"), _block(F.col("r"), limit).alias("r")),
                    "path-blocks")

    def cells(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        placed = lookup_join(rows.select("path", "grams"), blocks, ["path"], spread=["grams"])
        mine = F.pmod(F.xxhash64(F.lit(5), "grams"), F.col(own))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        at = [mine, F.col("other")] if side == 0 else [F.col("other"), mine]
        return placed.select(F.col("path").alias("x"), F.xxhash64("path", *at).alias("y"), F.lit(side).alias("side"),
                             "grams")

    return cells(left, "l", "r", 0).unionByName(cells(right, "r", "l", 1))


def _pivot_step(rows: DataFrame, texts: _Texts, n: int, percent: int, limit: int
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare dense nodes with a pivot each: edges to it, cells for its shell, and the rows that branch on.

    Nodes often share a pivot; what has been compared with it counts for all of them.
    """
    pivots = stored(rows.groupBy("path").agg(F.min_by(F.struct("grams", "sketch"), F.xxhash64("grams")).alias("p"))
                    .select("path", F.col("p.grams").alias("pivot"), F.col("p.sketch").alias("other")), "path-pivots")
    compared = stored(lookup_join(rows, pivots, ["path"], spread=["grams"]).select("path", "grams", "pivot", "sketch", "other")
                      .mapInArrow(_agreement, "path long, grams binary, pivot binary, agree int"), "path-compared")
    may_link = F.col("agree") >= sketch_bound(percent / 100)
    may_near = F.col("agree") >= sketch_bound(2 * percent / 100 - 1)
    dense = stored(compared.groupBy("path").agg(F.avg(may_link.cast("int")).alias("share")).filter(F.col("share") >= DENSE)
                   .select("path"), "path-dense")
    close = stored(lookup_join(compared, dense, ["path"], "left_semi", spread=["grams"]).filter(may_near)
                   .groupBy("pivot", "grams").agg(F.max(may_link).alias("may_link")), "path-close")
    checked = close.filter("may_link")
    blocks = checked.groupBy("pivot").agg(_block(F.count(F.lit(1)), PIVOT_BLOCK).alias("blocks"))
    members = lookup_join(checked, blocks, ["pivot"], spread=["grams"]).select(
        "pivot", F.pmod(F.xxhash64(F.lit(4), "grams"), F.col("blocks")).alias("block"), F.lit(False).alias("first"), "grams")
    copies = blocks.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                           F.lit(True).alias("first"), F.col("pivot").alias("grams"))
    hits = stored(texts.join(members.unionByName(copies)).repartition("pivot", "block")
                  .sortWithinPartitions("pivot", "block", F.col("first").desc())
                  .mapInArrow(lambda b: _against_pivot(b, n, percent), "pivot binary, grams binary"), "path-hits")
    edges = hits.filter(F.col("grams") != F.col("pivot")).select(F.col("grams").alias("a"), F.col("pivot").alias("b"))
    shell = close.join(hits, ["pivot", "grams"], "left_anti")
    cells = _sides(*[side.select(F.xxhash64("pivot").alias("path"), "grams") for side in (hits, shell)], limit)
    done = (dense.join(pivots.select("path", "pivot"), "path")
            .join(hits, "pivot").select("path", "grams"))
    return edges, cells, rows.join(done, ["path", "grams"], "left_anti")


def _edges(source: DataFrame, classes: DataFrame, n: int, percent: int, recall: float, small: int, most_counts: int
           ) -> DataFrame:
    """Edges between classes that connect all linked ones."""
    texts = _Texts(source, classes)
    filled = classes.filter("n_grams > 0")
    trees = choose_trees(percent / 100, recall)
    every = F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))
    rows, leaves, edges, cells = _descend(filled, every, True, FIRST_LEVELS), [], [], []
    for count in range(1, most_counts + 1):
        members = _counted(rows, small)
        leaves.append(members.filter("small"))
        large = members.filter("not small").select("path", "grams")
        if large.isEmpty():
            break
        if count == most_counts:
            cells.append(_sides(large, large, small))
            break
        whole = stored(lookup_join(filled.select("grams", "n_grams", "path_values", "sketch"), large, ["grams"]), "path-large")
        near, shell, rest = _pivot_step(whole, texts, n, percent, small)
        edges.append(near)
        cells.append(shell)
        rows = _descend(rest, F.array("path"), False, MORE_LEVELS)

    together = reduce(DataFrame.unionByName, leaves).select("path", "grams")
    least = sketch_bound(percent / 100)
    alike = (lookup_join(filled.select("grams", "sketch"), together, ["grams"]).select("path", "grams", "sketch")
             .repartition("path").sortWithinPartitions("path")
             .mapInArrow(lambda b: _alike(b, least), "x long, y long, grams binary"))
    groups = stored(alike.distinct().withColumn("side", F.lit(0)).select("x", "y", "side", "grams"), "path-groups")
    sent = texts.join(reduce(DataFrame.unionByName, cells, groups))
    edges.append(sent.repartition("x", "y").sortWithinPartitions("x", "y")
                 .mapInArrow(lambda b: _verify(b, n, percent), "a binary, b binary"))
    return stored(reduce(DataFrame.unionByName, edges), "path-edges")


def linked_components(docs: DataFrame, n: int = 3, percent: int = 85, recall: float = 0.9999, id_col: str = "doc_id",
                      text_col: str = "text", small: int = SMALL_SETS, most_counts: int = MOST_COUNTS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Texts are lower-cased in A-Z and cut into words at ASCII blanks; a set holds the distinct ``n``-word
    shingles, or all words as one shingle if there are fewer. Rows are linked if 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id reachable by links, ``kept`` whether it is the row's own.

    Null, empty and blank texts have no shingles and are linked with nothing, not even each other. Other rows
    with equal sets are linked, repeated rows too. Null ids are passed over when the smallest is taken; a row
    without an id is kept only where no row of its component has one. Rows that share an id share ``kept`` if they
    share the component. An empty table gives no rows. Other columns are not read. Pairs at the threshold are
    found with probability ``recall`` or more, others with more; those found are exact.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.xxhash64(text_col).alias("mark"))
    signed = stored(_signatures(source, n), "path-signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    classes = stored(signed.groupBy("grams").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"),
        F.first("path_values").alias("path_values"), F.first("sketch").alias("sketch")), "path-classes")
    edges = _edges(source, classes, n, percent, recall, small, most_counts)
    known = (classes.filter("n_grams > 0").select("grams", "copies", F.when(~F.col("first.none"), F.col("first.id")).alias("id"))
             .join(components(edges).withColumnRenamed("node", "grams"), "grams", "left"))
    # classes of one row without links need no look-up
    known = known.filter("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "grams"))
    least = known.groupBy("label").agg(F.min("id").alias("component_id"))
    more = stored(known.join(least, "label").select("grams", "component_id"), "path-components")
    found = lookup_join(signed.select("doc_id", "mark", "n_grams", "grams"), more.withColumn("known", F.lit(True)),
                        ["grams"], "left", spread=["doc_id", "mark"])
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n_grams").alias("n_shingles"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))
