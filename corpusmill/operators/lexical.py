"""Lexical side of the search: postings, statistics, BM25 scores.

Stored postings lie in folders by a hash of the term, sorted by term and block. A query batch reads the
folders of its terms. If these have few postings, they are sent to their documents and summed there per query;
else blocks that can matter are found by bounds first (``operators.bounded``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusmill.functions import scores, text
from corpusmill.operators.bounded import BlockSearch, Weighting, summed_by_document
from corpusmill.runtime import is_small, lookup_join, near, stored, top_per_group

# From so many postings of a batch's terms on, their blocks are chosen by bounds before they are read.
MANY_POSTINGS = 5_000_000
# Bytes of text of which a task holds the counts.
TASK_TEXT = 16 << 20
# Bytes of text that are counted at once where documents are counted by themselves.
SLICE_TEXT = 8 << 20


@dataclass(frozen=True)
class LexicalIndex:
    """``postings`` come in parts holding different documents; ``terms`` rows of one term add up."""

    docs: DataFrame                   # doc_id: every live document, matched or not
    postings: tuple[DataFrame, ...]   # doc_id, term, tf, dl (and block, folder, if stored)
    terms: DataFrame                  # term, df (and folder, if stored)
    stats: DataFrame                  # one row: n, total_dl, mean_idf
    folders: int | None = None        # number of folders that terms are hashed to, if stored
    blocks: tuple[DataFrame, ...] = ()  # directories of the postings' blocks, if stored

    @cached_property
    def totals(self) -> Row:
        """The statistics row; everything that depends on it becomes a literal in the plan."""
        return self.stats.first()


def lexical_tokens(corpus: DataFrame) -> DataFrame:
    """One row per document: its tokens, from the key summary if there is one, else the content."""
    return corpus.select("doc_id", text.tokens(text.lexical_text("metadata", "content")).alias("tokens"))


def build_postings(corpus: DataFrame) -> DataFrame:
    """Term frequencies and length per document; rows of one id and length are counted together.

    The narrow text rows are shuffled once by document, which is less data than exploded tokens and
    leaves the counting without a shuffle. A task gets a bounded share of the text, as it holds its counts.
    """
    rows = corpus.select("doc_id", text.lexical_text("metadata", "content").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    parts = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT))
    rows = rows.repartition(parts, "doc_id")
    rows = rows.select("doc_id", text.tokens("text").alias("tokens"))
    exploded = rows.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return exploded.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf")).select(
        "doc_id", "term", "tf", "dl")


def count_terms(corpus: DataFrame) -> DataFrame:
    """``build_postings`` of documents that all have ids of their own: each row is counted by itself.

    A task counts slices of bounded text, one after the other.
    """
    rows = corpus.select("doc_id", text.lexical_text("metadata", "content").alias("text"))
    return rows.mapInArrow(_counted_slices, "doc_id string, term string, tf long, dl long")


def _counted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.searchsorted(ends, np.arange(SLICE_TEXT, ends[-1], SLICE_TEXT)).tolist() if len(ends) else []
        for start, end in pairwise([0, *cuts, len(ends)]):
            if start < end:
                yield _counted(*(c.slice(start, end - start) for c in batch.columns))


def _counted(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words = pc.split_pattern(texts, " ")
    found = pc.list_flatten(words).dictionary_encode()
    terms = max(len(found.dictionary), 1)
    docs = pc.list_parent_indices(words).to_numpy()
    pairs, tf = np.unique(docs * terms + found.indices.to_numpy(), return_counts=True)
    own = pa.array(pairs // terms)
    return pa.RecordBatch.from_arrays(
        [ids.take(own), found.dictionary.take(pa.array(pairs % terms)), pa.array(tf, pa.int64()),
         pc.list_value_length(words).take(own).cast(pa.int64())], names=["doc_id", "term", "tf", "dl"])


def document_frequencies(corpus: DataFrame) -> DataFrame:
    """Documents per term, straight from the texts: counts combine before the shuffle on the term."""
    words = lexical_tokens(corpus).select(F.explode(F.array_distinct("tokens")).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Number of documents, tokens and mean length, duplicates counted."""
    lengths = lexical_tokens(corpus).select(F.size("tokens").cast("long").alias("dl"))
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl"),
                       F.avg("dl").alias("avgdl"))


def df_histogram(terms: DataFrame) -> DataFrame:
    """Words per document frequency: all that the mean idf needs to know of the vocabulary."""
    return terms.groupBy("df").agg(F.count(F.lit(1)).alias("words"))


def with_mean_idf(totals: DataFrame, histogram: DataFrame) -> DataFrame:
    """Add the mean unfloored idf over the vocabulary."""
    n = totals.select("n").scalar()
    mean = histogram.agg((F.sum(scores.raw_idf(n, F.col("df")) * F.col("words")) / F.sum("words")).alias("m"))
    return totals.withColumn("mean_idf", mean.scalar())


def idf_table(terms: DataFrame, stats: DataFrame, epsilon: float = scores.EPSILON) -> DataFrame:
    """Floored idf per term."""
    raw = scores.raw_idf(stats.select("n").scalar(), F.col("df"))
    mean = stats.select("mean_idf").scalar()
    return terms.select("term", "df", scores.floored_idf(raw, mean, epsilon).alias("idf"))


def build_index(corpus: DataFrame) -> LexicalIndex:
    terms = document_frequencies(corpus)
    return LexicalIndex(docs=corpus.select("doc_id"), postings=(build_postings(corpus),), terms=terms,
                        stats=with_mean_idf(corpus_stats(corpus), df_histogram(terms)))


def query_terms(queries: DataFrame) -> DataFrame:
    """Tokens per query with their multiplicity."""
    words = queries.select("query_id", F.explode(text.tokens("query")).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def where_terms_lie(words: DataFrame, index: LexicalIndex) -> Callable[[DataFrame], DataFrame]:
    """Reduce stored tables to the folders of the given terms."""
    if index.folders is None:
        return lambda table: table
    return lambda table: near(table, "term", words, index.folders).drop("folder")


def query_weights(queries: DataFrame, index: LexicalIndex, epsilon: float = scores.EPSILON,
                  small: bool | None = None) -> DataFrame:
    """idf x multiplicity per query term, and df; terms the corpus lacks weigh nothing and are dropped."""
    words = query_terms(queries)
    if small if small is not None else is_small(words):
        known = where_terms_lie(words, index)(index.terms).join(F.broadcast(words), "term")
    else:  # a term may occur in most queries: spread those, copy its one row of the index
        known = lookup_join(words, index.terms.select("term", "df"), ["term"], "inner", spread=["query_id"],
                            small=False)
    known = known.groupBy("query_id", "term", "qtf").agg(F.sum("df").alias("df")).filter(F.col("df") > 0)
    raw = scores.raw_idf(F.lit(index.totals["n"]), F.col("df"))
    idf = scores.floored_idf(raw, F.lit(index.totals["mean_idf"]), epsilon)
    return known.select("query_id", "term", (F.col("qtf") * idf).alias("weight"), "df")


def score_bm25(queries: DataFrame, index: LexicalIndex, k1: float = scores.K1, b: float = scores.B,
               epsilon: float = scores.EPSILON, small: bool | None = None) -> DataFrame:
    """BM25 per query and matched document: query_id, doc_id, score."""
    if small is None:
        small = is_small(query_terms(queries))
    return _summed(query_terms(queries), query_weights(queries, index, epsilon, small), index, k1, b, small)


def weighting(index: LexicalIndex, k1: float = scores.K1, b: float = scores.B) -> Weighting:
    return Weighting(index.totals["total_dl"] / max(index.totals["n"], 1), k1, b)


def _summed(words: DataFrame, weights: DataFrame, index: LexicalIndex, k1: float, b: float, small: bool,
            best: int | None = None) -> DataFrame:
    """Weighted postings of all query terms, summed per query and document; at least the ``best`` of each query if given."""
    reduced = where_terms_lie(words, index)
    if small:
        matches = weights.agg(F.sum("df").alias("n")).first()["n"] or 0
        return summed_by_document([reduced(p) for p in index.postings], weights.select("query_id", "term", "weight"),
                                  weighting(index, k1, b), matches, best)
    weights = weights.select("query_id", "term", "weight")
    summand = F.col("weight") * weighting(index, k1, b).of(F.col("tf"), F.col("dl"))

    counts = index.terms.groupBy("term").agg(F.sum("df").alias("n"))

    def score(postings: DataFrame) -> DataFrame:
        matched = lookup_join(reduced(postings), weights, ["term"], "inner", spread=["doc_id"], small=small, counts=counts)
        return matched.select("query_id", "doc_id", summand.alias("score"))

    # a document's postings are all in one part
    matched = reduce(DataFrame.unionByName, map(score, index.postings))
    return matched.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def bm25_topk(queries: DataFrame, index: LexicalIndex, n: int, k1: float = scores.K1, b: float = scores.B,
              epsilon: float = scores.EPSILON, small: bool | None = None, many_postings: int = MANY_POSTINGS) -> DataFrame:
    """Best ``n`` of *all* documents per query, documents scoring zero included, ties by doc_id.

    If the batch's terms have ``many_postings`` or more in a stored index, only those in blocks that can matter
    are read; hits and scores are the same.

    A document outside the postings of a query scores zero. The ``2n`` smallest ids always hold ``n``
    documents that are not among fewer than ``n`` positive ones, so only those are offered as padding.

    Where the mean idf is negative, the floored terms weigh less than nothing and zeros outrank the
    documents they occur in. Then as many of the smallest ids are offered as hold ``n`` unmatched ones
    for every query.
    """
    order = [scores.order_score(F.col("score")).desc(), F.col("doc_id")]
    negative = (index.totals["mean_idf"] or 0) < 0
    scored = _scored(queries, index, n, k1, b, epsilon, small, math.inf if negative else many_postings)
    if negative:
        best = scored = stored(scored, "scored")
        offered_ids = _smallest_ids(index.docs, scored, n, index.totals["n"])
    else:
        best = top_per_group(scored.filter(scores.order_score(F.col("score")) > 0), ["query_id"], order, n, ["doc_id"])
        offered_ids = index.docs.orderBy("doc_id").limit(2 * n)
    padding = offered_ids.agg(F.collect_list("doc_id").alias("ids")).scalar()
    zeros = queries.select("query_id", F.explode(padding).alias("doc_id"), F.lit(0.0).alias("score"))
    # A zero offered for a matched document adds nothing to its score.
    offered = best.select("query_id", "doc_id", "score").unionByName(zeros)
    summed = offered.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return top_per_group(summed, ["query_id"], order, n, ["doc_id"])


def _scored(queries: DataFrame, index: LexicalIndex, n: int, k1: float, b: float, epsilon: float, small: bool | None,
            many_postings: float) -> DataFrame:
    """Scores of all matched documents, or by bounds of those that can be among the best ``n``."""
    words = query_terms(queries)
    if small is None:
        small = is_small(words)
    weights = query_weights(queries, index, epsilon, small)
    if not index.blocks or many_postings == math.inf:
        return _summed(words, weights, index, k1, b, small)  # postings that are not stored are counted by each read
    weights = stored(weights, "query-weights")
    postings = weights.select("term", "df").distinct().agg(F.sum("df").alias("n")).first()["n"] or 0
    if postings < many_postings:
        return _summed(words, weights, index, k1, b, small, n)
    reduced = where_terms_lie(weights, index)
    named = weights.select("term").distinct()
    parts = [(reduced(p), lookup_join(reduced(d), named, ["term"], "left_semi", spread=["block"], small=small))
             for p, d in zip(index.postings, index.blocks)]
    return BlockSearch(weights.select("query_id", "term", "weight"), parts, weighting(index, k1, b), n).scores()


def _smallest_ids(docs: DataFrame, scored: DataFrame, n: int, total: int) -> DataFrame:
    """The smallest document ids, so many that every query leaves ``n`` of them unmatched."""
    wanted = 4 * n
    while True:
        ids = stored(docs.select("doc_id").orderBy("doc_id").limit(wanted), "smallest-ids")
        if wanted >= total:
            return ids
        matched = lookup_join(scored, ids, ["doc_id"], "left_semi", spread=["query_id"]).groupBy("query_id").count()
        if (matched.agg(F.max("count")).first()[0] or 0) <= wanted - n:
            return ids
        wanted *= 4
