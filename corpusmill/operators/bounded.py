"""BM25 top-k that reads only the blocks of postings which can still matter.

A term's postings lie in blocks: block 0 holds those of highest weight, the others are dealt by a hash of
the document, so a document's posting is in one of two blocks that can be told without looking. A
directory keeps for each block its highest weight with the mean length and parameters at the time of writing,
its highest term frequency and its shortest document, which bound the weight of all its postings whatever
these are by then.

1. Block 0 of each query term gives partial scores. The n-th of a query is a bar that its hits must reach.
2. A query's terms are ranked by their highest weights. A document is found by the highest ranked term it
   holds, so a block is only read if its highest weight, with the highest weights of the terms ranked below,
   reaches the bar (MaxScore and block-max bounds: Turtle and Flood 1995, Ding and Suel 2011).
3. The documents found that can still reach the bar look up their postings in blocks that were not read.

A document of which no block is read so cannot be among the best n, and hits and scores are exact.

Postings read in steps 2 and 3 are sent once per query. Where bounds leave so many that the terms' postings
are fewer when each is sent once, to its document, they are summed there instead, and the bar drops the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import scores
from corpusmill.runtime import in_pieces, is_small, lookup_join, stored, top_per_group

# Postings of a block, about; of block 0 exactly.
BLOCK_POSTINGS = 128
# Scores are ranked by nine places.
SLACK = 1e-6
# A task sums about so many weighted postings.
TASK_MATCHES = 2_000_000
# Of these it holds so many at once.
TASK_CELLS = 1_000_000
# Where only the best are wanted, postings are summed in at most so many turns, each of some documents, so only a part
# of them is in a shuffle. The matched ones are read once and written in as many pieces.
SUM_TURNS = 4


def _doc_block(blocks: Column) -> Column:
    """Block of a document's posting among ``blocks`` blocks from 1 on."""
    return 1 + F.pmod(F.xxhash64("doc_id"), blocks)


def with_blocks(postings: DataFrame, mean: float, counts: DataFrame | None = None, size: int = BLOCK_POSTINGS
                ) -> DataFrame:
    """``postings`` (doc_id, term, tf, dl; a written table) with their ``block``; ``mean`` is the mean length.

    ``counts`` (term, n) saves counting the postings per term. Terms of at most ``size`` postings have block 0 alone. For the others the border of block 0 is found per
    term, which combines before its shuffle, and given to the postings by a join that spreads hot terms.
    """
    if counts is None:
        counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    long = counts.filter(F.col("n") > size).select("term", "n")
    if long.isEmpty():
        return postings.withColumn("block", F.lit(0))
    impact = F.struct(scores.term_weight(F.col("tf"), F.col("dl"), F.lit(mean)).alias("impact"),
                      F.xxhash64("doc_id").alias("tie"))
    ranked = lookup_join(postings, long.select("term"), ["term"], "left_semi", spread=["doc_id"]).select(
        "term", impact.alias("impact"))
    best = top_per_group(ranked, ["term"], [F.col("impact").desc()], size, ["impact"])
    # written, as it is measured before it is joined
    border = stored(long.join(best.groupBy("term").agg(F.min("impact").alias("border")), "term").select(
        "term", "border", F.ceil((F.col("n") - size) / size).alias("blocks")), "block-borders")
    placed = lookup_join(postings, border, ["term"], "left", spread=["doc_id"])
    first = F.col("border").isNull() | (impact >= F.col("border"))
    return placed.withColumn("block", F.when(first, 0).otherwise(_doc_block(F.col("blocks"))).cast("int")).drop(
        "border", "blocks")


def term_counts(postings: DataFrame, mean: float) -> DataFrame:
    """Per term its postings ``n``, their summed ``tf``, and what a directory holds of them: ``top``, ``dl``, ``weight``."""
    weight = scores.term_weight(F.col("tf"), F.col("dl"), F.lit(mean))
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"), F.max("tf").alias("top"),
                                        F.min("dl").alias("dl"), F.max(weight).alias("weight"))


def directory_by_counts(postings: DataFrame, mean: float, counts: DataFrame, size: int = BLOCK_POSTINGS) -> DataFrame:
    """``block_directory`` where ``term_counts`` are known: only terms of several blocks are grouped."""
    single = counts.filter(F.col("n") <= size).select(
        "term", F.lit(0).alias("block"), "n", F.col("top").alias("tf"), "dl", "weight", F.lit(mean).alias("mean"))
    long = counts.filter(F.col("n") > size).select("term")
    if long.isEmpty():
        return single
    return block_directory(lookup_join(postings, long, ["term"], "left_semi", spread=["doc_id"]), mean).unionByName(single)


def block_directory(postings: DataFrame, mean: float) -> DataFrame:
    """``term, block, n, tf, dl, weight, mean``: size, highest frequency, shortest document, highest weight by block."""
    weight = scores.term_weight(F.col("tf"), F.col("dl"), F.lit(mean))
    return postings.groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.max(weight).alias("weight"),
        F.lit(mean).alias("mean"))


@dataclass(frozen=True)
class Weighting:
    """BM25's weight of a posting, and a bound of it for a block."""

    avgdl: float
    k1: float = scores.K1
    b: float = scores.B

    def of(self, tf: Column, dl: Column) -> Column:
        return scores.term_weight(tf, dl, F.lit(self.avgdl), self.k1, self.b)

    def bound(self) -> Column:
        """From a directory's columns. A mean length that grows r times raises no weight more than r times."""
        loose = self.of(F.col("tf"), F.col("dl"))
        if (self.k1, self.b) != (scores.K1, scores.B):
            return loose
        return F.least(loose, F.col("weight") * F.greatest(F.lit(self.avgdl) / F.col("mean"), F.lit(1.0)))


def summed_by_document(postings: list[DataFrame], weights: DataFrame, weighting: Weighting, matches: int,
                       best: int | None = None, bars: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score``: all weighted postings summed. Each posting of the terms is sent once, to its document.

    ``weights`` (query_id, term, weight) and ``bars`` are sent to the tasks; ``matches`` is the number of weighted
    postings, of which a task gets a bounded share. If no more than the ``best`` documents of each query are wanted and
    matches are many, those of each turn are written, and only they are returned. ``bars`` (query_id, bar) drops
    documents below before they are ranked; a query without a bar keeps those above -1.
    """
    turns = 1 if best is None else max(1, min(SUM_TURNS, matches // TASK_MATCHES))
    parts = max(weights.sparkSession.sparkContext.defaultParallelism, -(-matches // (TASK_MATCHES * turns)))
    named = F.broadcast(weights.select("term").distinct())
    rows = reduce(DataFrame.unionByName, [
        p.select("doc_id", "term", "tf", "dl").join(named, "term", "left_semi") for p in postings])
    summed = _sums(weights, weighting, bars, parts)
    if turns == 1:
        return summed(rows)
    order = [scores.order_score(F.col("score")).desc(), F.col("doc_id")]
    parted = in_pieces(rows, F.pmod(F.xxhash64("doc_id"), F.lit(turns)).cast("int"), turns, "matched-postings")
    return reduce(DataFrame.unionByName, [
        stored(top_per_group(summed(part), ["query_id"], order, best, ["doc_id"]).drop("rank"), "best-sums")
        for part in parted.turns(turns)])


def _sums(weights: DataFrame, weighting: Weighting, bars: DataFrame | None, parts: int) -> Callable[[DataFrame], DataFrame]:
    """Postings to ``query_id, doc_id, score``: they are dealt by document, each task sums those it gets."""
    spark, table = weights.sparkSession, weights.select("query_id", "term", "weight").toArrow().combine_chunks()
    query = pc.dictionary_encode(table["query_id"].combine_chunks(), null_encoding="encode")
    term = table["term"].combine_chunks().dictionary_encode()
    lines = np.argsort(term.indices.to_numpy(), kind="stable")
    starts = np.searchsorted(term.indices.to_numpy()[lines], np.arange(len(term.dictionary) + 1))
    least = np.full(len(query.dictionary), -np.inf)
    if bars is not None:
        known = bars.toArrow().combine_chunks()
        least[:] = -1.0
        least[pc.index_in(known["query_id"], query.dictionary).to_numpy()] = known["bar"].to_numpy()
    shared = spark.sparkContext.broadcast((
        query.dictionary, term.dictionary, starts, query.indices.to_numpy()[lines], table["weight"].to_numpy()[lines], least))
    parameters = weighting.avgdl, weighting.k1, weighting.b

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [batch for batch in batches if len(batch)]
        if found:
            yield from _added(pa.Table.from_batches(found), parameters, *shared.value)

    schema = T.StructType([weights.schema["query_id"], T.StructField("doc_id", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return lambda rows: rows.select("doc_id", "term", "tf", "dl").repartition(parts, "doc_id").mapInArrow(add_up, schema)


def _added(rows: pa.Table, parameters: tuple[float, float, float], queries: pa.Array, terms: pa.Array, starts: np.ndarray,
           query: np.ndarray, weight: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Weighted sums of all postings of some documents, by whole documents of about TASK_CELLS matches at a time."""
    avgdl, k1, b = parameters
    ids = pc.dictionary_encode(rows["doc_id"].combine_chunks(), null_encoding="encode")
    order = np.argsort(ids.indices.to_numpy(), kind="stable")
    doc = ids.indices.to_numpy()[order].astype(np.int64)
    term = pc.index_in(rows["term"].combine_chunks(), terms).to_numpy()[order]
    tf, dl = rows["tf"].to_numpy()[order], rows["dl"].to_numpy()[order]
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    matches = starts[term + 1] - starts[term]
    first = np.flatnonzero(np.diff(doc, prepend=-1))  # of each document
    before = np.concatenate([[0], np.cumsum(matches)])[first]
    cuts = np.unique([0, *first[np.searchsorted(before, np.arange(TASK_CELLS, before[-1], TASK_CELLS))], len(doc)])
    for start, end in pairwise(cuts.tolist()):
        many, base = matches[start:end], doc[start]
        row = np.repeat(np.arange(start, end), many)
        line = np.arange(len(row)) + np.repeat(starts[term[start:end]] - (np.cumsum(many) - many), many)
        cell, score = (doc[row] - base) * len(queries) + query[line], weight[line] * impact[row]
        cells = int(doc[end - 1] - base + 1) * len(queries)
        if cells <= 4 * TASK_CELLS:
            sums, held = np.bincount(cell, score, cells), np.flatnonzero(np.bincount(cell, minlength=cells))
            sums = sums[held]
        else:
            held, at = np.unique(cell, return_inverse=True)
            sums = np.bincount(at, score)
        kept = sums >= least[held % len(queries)]
        held, sums = held[kept], sums[kept]
        yield pa.RecordBatch.from_arrays(
            [queries.take(pa.array(held % len(queries))), ids.dictionary.take(pa.array(held // len(queries) + base)),
             pa.array(sums, pa.float64())], names=["query_id", "doc_id", "score"])


class BlockSearch:
    """One batch of weighted query terms (query_id, term, weight; no weight negative) over blocked postings.

    ``parts`` are pairs of postings and directory that hold different documents; both are given as far as they
    hold the batch's terms.
    """

    def __init__(self, weights: DataFrame, parts: list[tuple[DataFrame, DataFrame]], weighting: Weighting, n: int):
        self._n, self._weighting = n, weighting
        self._postings = [postings for postings, _ in parts]
        bound = weighting.bound().alias("bound")
        self.directory = stored(reduce(DataFrame.unionByName, [
            directory.select(F.lit(i).alias("part"), "term", "block", "n", bound)
            for i, (_, directory) in enumerate(parts)]), "block-directory")
        tops = self.directory.groupBy("term").agg(F.max("bound").alias("top"), F.count(F.lit(1)).alias("blocks"),
                                                  F.sum("n").alias("postings"))
        self._weights = stored(lookup_join(weights, tops, ["term"], spread=["query_id"]).withColumn(
            "top", F.col("top") * F.col("weight")), "block-weights")
        self.bars = stored(self._bars(), "block-bars")
        self._terms = self._ranked_terms()

    @cached_property
    def needed(self) -> DataFrame:
        return stored(self._needed_blocks(), "blocks-needed")

    @cached_property
    def _unread(self) -> DataFrame:
        return stored(self._unread_terms(), "terms-unread")

    @cached_property
    def _read(self) -> DataFrame:
        return stored(reduce(DataFrame.unionByName, [
            self._matched(i, self.needed.filter(F.col("part") == i).select("query_id", "term", "block", "weight"),
                          ["term", "block"]) for i in range(len(self._postings))]), "postings-read")

    def _matched(self, part: int, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """Weighted postings of ``part`` that ``wanted`` (keys, query_id, weight) names."""
        found = lookup_join(self._postings[part], wanted, keys, spread=["doc_id"])
        return found.select("query_id", "term", "doc_id",
                            (F.col("weight") * self._weighting.of(F.col("tf"), F.col("dl"))).alias("score"))

    def _bars(self) -> DataFrame:
        """``query_id, bar``: the n-th partial score of each query that has so many."""
        opening = self._weights.select("query_id", "term", "weight").withColumn("block", F.lit(0))
        matched = [self._matched(i, opening, ["term", "block"]) for i in range(len(self._postings))]
        partial = reduce(DataFrame.unionByName, matched).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
        best = top_per_group(partial, ["query_id"], [F.col("score").desc()], self._n, ["doc_id"])
        return best.groupBy("query_id").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("m")).filter(
            F.col("m") >= self._n).select("query_id", (F.col("bar") - SLACK).alias("bar"))

    def _ranked_terms(self) -> DataFrame:
        """Query terms with the bar and ``below``, the highest weights of the terms ranked below.

        The window is over one query's terms.
        """
        lower = Window.partitionBy("query_id").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, -1)
        return self._weights.join(self.bars, "query_id", "left").select(
            "query_id", "term", "weight", "top", "blocks", F.coalesce("bar", F.lit(-1.0)).alias("bar"),
            F.coalesce(F.sum("top").over(lower), F.lit(0.0)).alias("below"))

    def _needed_blocks(self) -> DataFrame:
        """``query_id, part, term, block, weight, n`` of the blocks that find documents."""
        blocks = lookup_join(self.directory, self._terms, ["term"], spread=["block"])
        return blocks.filter(F.col("bound") * F.col("weight") + F.col("below") >= F.col("bar")).select(
            "query_id", "part", "term", "block", "weight", "n")

    def _unread_terms(self) -> DataFrame:
        """``query_id, term, weight, top, bar`` of the terms with blocks that were not read."""
        read = self.needed.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("read"))
        return self._terms.join(read, ["query_id", "term"], "left").filter(
            F.coalesce("read", F.lit(0)) < F.col("blocks")).select("query_id", "term", "weight", "top", "bar")

    def found(self) -> DataFrame:
        """``query_id, doc_id, score``: documents that can reach the bar, scored by the blocks that were read."""
        # a term that has matched a document adds no more to it
        met = lookup_join(self._read, self._unread.select("query_id", "term", "top"), ["query_id", "term"], "left",
                          spread=["doc_id"])
        partial = met.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"),
                                                        F.sum(F.coalesce("top", F.lit(0.0))).alias("met"))
        rest = self._unread.groupBy("query_id").agg(F.sum("top").alias("rest"), F.first("bar").alias("bar"))
        reach = F.col("score") + F.coalesce(F.col("rest") - F.col("met"), F.lit(0.0))
        return lookup_join(partial, rest, ["query_id"], "left", spread=["doc_id"]).filter(
            reach >= F.coalesce("bar", F.lit(-1.0))).select("query_id", "doc_id", "score")

    def lookups(self, found: DataFrame) -> DataFrame:
        """``part, term, block, doc_id, query_id, weight`` where found documents can have postings not read."""
        sizes = self.directory.groupBy("part", "term").agg(F.max("block").alias("blocks"))
        pairs = lookup_join(found.select("query_id", "doc_id"), self._unread.select("query_id", "term", "weight"),
                            ["query_id"], spread=["doc_id"])
        met = ["query_id", "term", "doc_id"]  # a document has one posting of a term
        placed = lookup_join(pairs.join(self._read.select(*met), met, "left_anti"), sizes, ["term"], spread=["doc_id"])
        own = F.when(F.col("blocks") > 0, F.array(F.lit(0), _doc_block(F.col("blocks")).cast("int"))).otherwise(
            F.array(F.lit(0)))
        asked = placed.select("part", "term", F.explode(own).alias("block"), "doc_id", "query_id", "weight")
        keys = ["query_id", "part", "term", "block"]
        return lookup_join(asked, self.needed.select(*keys), keys, "left_anti", spread=["doc_id"])

    def _lookups_at_most(self, found: DataFrame) -> int:
        sizes = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("docs"))
        terms = self._unread.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
        return sizes.join(terms, "query_id").agg(F.sum(2 * F.col("docs") * F.col("terms")).alias("n")).first()["n"] or 0

    def _by_document(self) -> DataFrame:
        """Documents that reach the bar of a query, the best n at least, from all postings of the batch's terms."""
        matches = self._weights.agg(F.sum("postings").alias("n")).first()["n"] or 0
        return summed_by_document(self._postings, self._weights.select("query_id", "term", "weight"), self._weighting,
                                  matches, self._n, self.bars)

    def scores(self) -> DataFrame:
        """``query_id, doc_id, score``: exact for every document that can be among the best n of its query."""
        once = self.directory.agg(F.sum("n").alias("n")).first()["n"] or 0
        few = is_small(self._weights)  # else the weights are not broadcast
        if few and (self._needed_blocks().agg(F.sum("n").alias("n")).first()["n"] or 0) > once:
            return self._by_document()
        found = stored(self.found(), "blocks-found")
        if few and self._lookups_at_most(found) > once:
            return self._by_document()
        asked = stored(self.lookups(found), "block-lookups")
        keys = ["term", "block", "doc_id"]
        more = [self._matched(i, asked.filter(F.col("part") == i).drop("part"), keys).drop("term")
                for i in range(len(self._postings))]
        return reduce(DataFrame.unionByName, more, found).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
