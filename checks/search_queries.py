"""Lexical and vector search, fusion, answers, maintenance, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.document_queries import source_documents
from checks.registry import Tables, query
from corpusmill.functions import encoders, scores, text
from corpusmill.operators import answers, collection, fusion, lexical, vector, vector_lists
from corpusmill.operators.vector import recall
from corpusmill.plans import ingest as ingest_plan
from corpusmill.plans import search as search_plan
from corpusmill.runtime import scratch_dir, stored
from corpusmill.sources import corpus_json
from corpusmill.sources.index_store import (Index, as_corpus, commit_changes, committed_files, load_index, save_index,
                                            stored_index)
from corpusmill.streaming import jobs

K = 5
N = 2 * K

# --- bindings --------------------------------------------------------------------------------------


def corpus(t: Tables) -> DataFrame:
    """All documents; a vector where ``embeddings`` has one; labels and source as metadata."""
    entry = F.map_filter(F.create_map(
        F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"),
        F.lit("quality"), F.col("quality").cast("string")), lambda _, v: v.isNotNull())
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    joined = t.documents.join(vectors, "doc_id", "left").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"),
                         entry.alias("metadata"), "embedding")


def questions(t: Tables) -> DataFrame:
    """All benchmark items, with the vector of the same id."""
    vectors = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vec"))
    return t.benchmark.join(vectors, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), "query_vec")


def vector_corpus(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")


CORPUS_SQL = """
corpus AS (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.text AS content, substr(sha1(d.text), 1, 20) AS doc_key,
                  CAST(e.embedding AS DOUBLE[]) AS embedding, d.source, d.lang, d.n_chars, l.quality
           FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
questions AS (SELECT b.item_id AS query_id, b.text AS query, CAST(e.embedding AS DOUBLE[]) AS query_vec
              FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""
TERMS_SQL = """
words AS MATERIALIZED (SELECT doc_id, unnest(string_split(content, ' ')) AS term FROM corpus),
lengths AS MATERIALIZED (SELECT doc_id, count(*) AS dl FROM words GROUP BY doc_id),
postings AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM dfs, totals),
mean AS (SELECT avg(idf0) AS mean_idf FROM raw),
idfs AS (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25 * mean_idf END AS idf FROM raw, mean)"""
BM25_SQL = f"""
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(string_split(query, ' ')) AS term FROM questions) GROUP BY 1, 2),
weights AS (SELECT query_id, term, qtf * idf AS weight FROM qterms JOIN idfs USING (term)),
matched AS (SELECT query_id, doc_id, sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
            FROM weights JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY 1, 2),
bm25_all AS (SELECT q.query_id, c.doc_id, coalesce(m.score, 0) AS score FROM questions q CROSS JOIN corpus c
             LEFT JOIN matched m ON m.query_id = q.query_id AND m.doc_id = c.doc_id),
bm25_list AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25_all) WHERE rank <= {N})"""


def vector_sql(limit: int, name: str = "vector_list", asked: str = "questions", having: str = "corpus") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT q.query_id, c.doc_id, 1 - (1 - list_cosine_similarity(q.query_vec, c.embedding)) / 2 AS score
  FROM {asked} q, {having} c WHERE q.query_vec IS NOT NULL AND c.embedding IS NOT NULL)) WHERE rank <= {limit})"""


FUSION_SQL = f"""
listed AS (
  SELECT query_id, doc_id, doc_key, rank, 'v' AS side,
    (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) + 1e-6) AS norm
  FROM vector_list JOIN corpus USING (doc_id)
  UNION ALL
  SELECT query_id, doc_id, doc_key, rank, 'l',
    (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) + 1e-6)
  FROM bm25_list JOIN corpus USING (doc_id)),
fused AS (
  SELECT query_id, doc_key,
    coalesce(arg_max(doc_id, rank) FILTER (side = 'v'), arg_min(doc_id, rank) FILTER (side = 'l')) AS doc_id,
    0.5 * coalesce(arg_max(norm, rank) FILTER (side = 'v'), 0) AS vector_score,
    0.5 * coalesce(arg_max(norm, rank) FILTER (side = 'l'), 0) AS bm25_score,
    coalesce(min(rank) FILTER (side = 'v'), {N} + min(rank) FILTER (side = 'l')) AS order_key
  FROM listed GROUP BY query_id, doc_key),
ranked AS (SELECT *, vector_score + bm25_score AS combined_score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score + bm25_score, 9) DESC, order_key) AS rank FROM fused),
hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, content, round(combined_score, 4) AS combined_score,
    round(vector_score, 4) AS vector_score, round(bm25_score, 4) AS bm25_score, source, lang, n_chars, quality
  FROM ranked JOIN corpus USING (doc_id) WHERE rank <= {K})"""
HITS_SQL = f"WITH {CORPUS_SQL}, {TERMS_SQL}, {BM25_SQL}, {vector_sql(N)}, {FUSION_SQL}"


def hits(t: Tables) -> DataFrame:
    return search_plan.search(questions(t), stored_index(corpus(t)), K)


# --- lexical ---------------------------------------------------------------------------------------


@query("""SELECT doc_id, pos - 1 AS pos, tokens[pos] AS token FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM (
SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_split(CASE WHEN lang = 'de' THEN 'source: ' || source || ', lang: ' || lang ELSE text END, ' ') AS tokens FROM documents))""")
def lexical_tokens(t: Tables) -> DataFrame:
    summary = F.create_map(F.lit("key_summary"), F.concat(F.lit("source: "), "source", F.lit(", lang: "), "lang"))
    raw = t.documents.select("doc_id", F.col("text").alias("content"), F.when(F.col("lang") == "de", summary).alias("metadata"))
    rows = lexical.lexical_tokens(as_corpus(raw))
    return rows.select("doc_id", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {CORPUS_SQL}, {TERMS_SQL} SELECT doc_id, term, tf, dl FROM postings JOIN lengths USING (doc_id)")
def term_frequencies(t: Tables) -> DataFrame:
    return lexical.build_postings(as_corpus(corpus(t)))


@query(f"WITH {CORPUS_SQL}, {TERMS_SQL} SELECT term, df FROM dfs")
def document_frequencies(t: Tables) -> DataFrame:
    return lexical.document_frequencies(as_corpus(corpus(t)))


@query(f"WITH {CORPUS_SQL}, {TERMS_SQL} SELECT n, CAST(n * avgdl AS BIGINT) AS total_dl, round(avgdl, 4) AS avgdl FROM totals")
def corpus_stats(t: Tables) -> DataFrame:
    return lexical.corpus_stats(as_corpus(corpus(t))).withColumn("avgdl", F.round("avgdl", 4))


# Texts alone, where nothing else of the corpus is asked for.
TEXTS_SQL = """
corpus AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM documents),
questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""


@query(f"WITH {TEXTS_SQL}, {TERMS_SQL} SELECT term, df, round(idf, 4) AS idf FROM idfs")
def bm25_idf(t: Tables) -> DataFrame:
    index = lexical.build_index(as_corpus(documents_table(t)))
    return lexical.idf_table(index.terms, index.stats).withColumn("idf", F.round("idf", 4))


WEIGHTS_SQL = BM25_SQL[:BM25_SQL.index("matched AS")].rstrip().rstrip(",")


@query(f"WITH {TEXTS_SQL}, {TERMS_SQL}, {WEIGHTS_SQL} SELECT query_id, term, round(weight, 4) AS weight FROM weights")
def bm25_index(t: Tables) -> DataFrame:
    index = stored_index(documents_table(t)).lexical
    return lexical.query_weights(questions(t), index).select("query_id", "term", F.round("weight", 4).alias("weight"))


@query(f"WITH {CORPUS_SQL}, {TERMS_SQL}, {BM25_SQL} SELECT query_id, rank, doc_id, round(score, 4) AS score FROM bm25_list")
def bm25_topk(t: Tables) -> DataFrame:
    found = lexical.bm25_topk(questions(t), stored_index(corpus(t)).lexical, N)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", scores.round4(F.col("score")).alias("score"))


@query(f"WITH {CORPUS_SQL}, {TERMS_SQL}, {BM25_SQL} SELECT query_id, rank, doc_id, round(score, 4) AS score FROM bm25_list")
def bm25_topk_blocks(t: Tables) -> DataFrame:
    """By bounds, however few the postings are."""
    return shown(lexical.bm25_topk(questions(t), stored_index(corpus(t)).lexical, N, many_postings=0))


# --- vectors ---------------------------------------------------------------------------------------

VECTORS_SQL = "having AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"


POOL_SQL = VECTORS_SQL.replace("having", "pool")


@query(f"WITH {CORPUS_SQL}, {POOL_SQL}, {vector_sql(N, having='pool')} SELECT query_id, rank, doc_id, round(score, 4) AS score FROM vector_list")
def vector_topk(t: Tables) -> DataFrame:
    return shown(vector.vector_topk(questions(t), vector_corpus(t), N))


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", scores.round4(F.col("score")).alias("score"))


@query(f"WITH {CORPUS_SQL}, {POOL_SQL}, {vector_sql(3, having='pool')} SELECT query_id, rank, doc_id, round(score, 4) AS score FROM vector_list")
def vector_search(t: Tables) -> DataFrame:
    return shown(vector.vector_search(questions(t), vector_corpus(t)))


# The inverted file stops by its bounds, so its hits are those of all pairs.
@query(f"WITH {CORPUS_SQL}, {POOL_SQL}, {vector_sql(N, having='pool')} SELECT query_id, rank, doc_id, round(score, 4) AS score FROM vector_list")
def vector_topk_approx(t: Tables) -> DataFrame:
    lists = vector_lists.save_vector_lists(vector_corpus(t), scratch_dir(t.spark, "codes"), parts=16)
    return shown(vector_lists.search_lists(questions(t), lists, N))


@query(f"""WITH {CORPUS_SQL}, {POOL_SQL}, {vector_sql(N, having='pool')}
SELECT count(DISTINCT query_id) AS queries, count(*) AS found, count(*) AS expected, 1.0::DOUBLE AS recall FROM vector_list""")
def approx_recall(t: Tables) -> DataFrame:
    asked, pool = questions(t), vector_corpus(t)
    lists = vector_lists.save_vector_lists(pool, scratch_dir(t.spark, "codes"), parts=16)
    found = recall(vector_lists.search_lists(asked, lists, N), vector.vector_topk(asked, pool, N))
    return found.withColumn("recall", F.round("recall", 4))


@query("""WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents),
slots AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 7)) AS BIGINT) % 64 AS slot, count(*) AS c FROM words GROUP BY 1, 2)
SELECT doc_id, CAST(slot AS BIGINT) AS slot, round(CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 4) AS value FROM slots""")
def hash_embed(t: Tables) -> DataFrame:
    coded = encoders.encode(t.documents, "text", lambda c: encoders.hash_embed(c, 64))
    cells = coded.select("doc_id", F.posexplode("embedding").alias("slot", "value")).filter("value <> 0")
    return cells.select("doc_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("value").cast("double"), 4).alias("value"))


# --- fusion ----------------------------------------------------------------------------------------


@query(f"""WITH {CORPUS_SQL}, {POOL_SQL}, {vector_sql(N, having='pool')} SELECT query_id, doc_id,
round((score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) + 1e-6), 4) AS norm
FROM vector_list""")
def minmax_normalize(t: Tables) -> DataFrame:
    found = fusion.minmax_normalize(vector.vector_topk(questions(t), vector_corpus(t), N))
    return found.select("query_id", "doc_id", scores.round4(F.col("norm")).alias("norm"))


@query(f"""{HITS_SQL} SELECT query_id, doc_key, doc_id, round(vector_score, 4) AS vector_score, round(bm25_score, 4) AS bm25_score,
round(combined_score, 4) AS combined_score, CAST(order_key AS INTEGER) AS order_key FROM ranked""")
def hybrid_fusion(t: Tables) -> DataFrame:
    index = stored_index(corpus(t))
    lists = search_plan.candidate_lists(questions(t), index.corpus, index.lexical, K)
    # written, as they are measured before they are joined
    listed = fusion.with_doc_key(stored(fusion.candidates(*lists), "candidates"), index.corpus)
    return fusion.present_hits(fusion.fuse(listed, 0.5, N))


@query(f"{HITS_SQL} SELECT query_id, rank, doc_id, content, n_chars, combined_score, vector_score, bm25_score FROM hits")
def hybrid_search(t: Tables) -> DataFrame:
    return hits(t).withColumn("n_chars", text.meta_get("metadata", "n_chars").cast("long")).drop("metadata")


@query(f"{HITS_SQL} SELECT query_id, rank, doc_id, combined_score, vector_score, bm25_score FROM hits")
def hybrid_search_approx(t: Tables) -> DataFrame:
    index = stored_index(corpus(t), vector_lists=0)
    found = search_plan.search(questions(t), index, K, by_lists=True)
    return found.select("query_id", "rank", "doc_id", "combined_score", "vector_score", "bm25_score")


# Every query asks for 1 to 5 hits of its own; its lists are twice as long.
OWN_K = "(1 + query_id % 5)"
PER_QUERY_SQL = HITS_SQL.replace(f"WHERE rank <= {N}", f"WHERE rank <= 2 * {OWN_K}").replace(
    f"{N} + min(rank)", f"2 * {OWN_K} + min(rank)").replace(f"WHERE rank <= {K})", f"WHERE rank <= {OWN_K})")


@query(f"{PER_QUERY_SQL} SELECT query_id, rank, doc_id, combined_score, vector_score, bm25_score FROM hits")
def search_k_per_query(t: Tables) -> DataFrame:
    asked = questions(t).withColumn("k", 1 + F.col("query_id") % 5)
    found = search_plan.search(asked, stored_index(corpus(t)), 3)
    return found.select("query_id", "rank", "doc_id", "combined_score", "vector_score", "bm25_score")


# --- answers ---------------------------------------------------------------------------------------

CONTEXT_SQL = "contexts AS (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id)"


def prompt_sql() -> str:
    parts = text.PROMPT.replace("'", "''")
    head, rest = parts.split("{question}")
    middle, tail = rest.split("{context}")
    return f"'{head}' || query || '{middle}' || context || '{tail}'"


@query(f"{HITS_SQL}, {CONTEXT_SQL} SELECT query_id, context FROM contexts")
def prompt_context(t: Tables) -> DataFrame:
    return answers.build_context(hits(t))


@query(f"{HITS_SQL}, {CONTEXT_SQL} SELECT query_id, {prompt_sql()} AS prompt FROM contexts JOIN questions USING (query_id)")
def build_prompts(t: Tables) -> DataFrame:
    return answers.build_prompts(questions(t), hits(t)).select("query_id", "prompt")


@query(f"""{HITS_SQL}, {CONTEXT_SQL}, prompts AS (SELECT query_id, {prompt_sql()} AS prompt FROM contexts JOIN questions USING (query_id))
SELECT query_id, prompt || ' seen ' || sha1(prompt) || chr(10) AS admin_answer, 'seen ' || sha1(prompt) AS user_answer FROM prompts""")
def chat_answers(t: Tables) -> DataFrame:
    echo = lambda prompt: F.concat(prompt, F.lit(" seen "), F.sha1(prompt), F.lit("\n"))
    return search_plan.answer(questions(t), stored_index(corpus(t)), echo, search_plan.retriever(K))


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '##[USER_ANSWER]: end'
ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM conversations""")
def extract_answer(t: Tables) -> DataFrame:
    raw = F.when(F.col("role") == "assistant", F.concat(
        "role", F.lit("##[USER_ANSWER]: "), "text", F.lit("##[USER_ANSWER]: end "))).otherwise(F.concat(F.lit(" \n"), "text"))
    return t.conversations.select("conv_id", "turn", text.extract_answer(raw).alias("answer"))


@query(f"{HITS_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(n_chars AS DOUBLE) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, rank) AS best FROM hits) WHERE best = 1")
def recommend_best(t: Tables) -> DataFrame:
    rate = text.meta_get("metadata", "n_chars").try_cast("double")
    return answers.recommend_best(hits(t), rate).select("query_id", "doc_id", "rank", "rate")


FIELDS = {"bank": "source", "product": "lang", "base_rate": "n_chars", "top_rate": "quality", "conditions": "none"}


STRUCTURED_SQL = f"""{HITS_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, rank) AS b FROM hits WHERE quality IS NOT NULL) WHERE b = 1)
SELECT query_id, source AS bank, lang AS product, CAST(n_chars AS VARCHAR) AS base_rate, CAST(quality AS VARCHAR) AS top_rate,
CASE WHEN source IS NOT NULL THEN '정보 없음' END AS conditions, '최고 금리 ' || quality AS reason,
coalesce('bank: ' || source || chr(10) || 'product: ' || lang || chr(10) || 'base_rate: ' || n_chars || chr(10) || 'top_rate: ' || quality || chr(10) || 'conditions: 정보 없음' || chr(10) || 'reason: 최고 금리 ' || quality, '모르겠습니다') AS answer
FROM questions LEFT JOIN best USING (query_id)"""


@query(STRUCTURED_SQL)
def structured_answer(t: Tables) -> DataFrame:
    rate = text.meta_get("metadata", "quality").try_cast("double")
    return answers.structured_answers(questions(t), hits(t), rate, FIELDS)


@query(STRUCTURED_SQL)
def recommend(t: Tables) -> DataFrame:
    return search_plan.recommend(questions(t), stored_index(corpus(t)), FIELDS, K)


@query("""SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 1000000 + page_id FROM pages""")
def zero_hit_queries(t: Tables) -> DataFrame:
    bare = t.pages.select((F.col("page_id") + 1_000_000).alias("query_id"), F.lit(None).cast("array<float>").alias("query_vec"))
    asked = questions(t).select("query_id", "query_vec").unionByName(bare)
    return answers.zero_hit_queries(asked, vector.vector_topk(asked, vector_corpus(t), 1))


# --- maintenance -----------------------------------------------------------------------------------


def documents_table(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))


def changed_documents(t: Tables) -> DataFrame:
    """Benchmark items replace the documents of the same id; pages are new."""
    return t.benchmark.select(F.col("item_id").cast("string").alias("doc_id"), F.col("text").alias("content")).unionByName(
        t.pages.select(F.concat(F.lit("page_"), "page_id").alias("doc_id"), F.col("html").alias("content")))


UPSERT_SQL = """changed AS (SELECT CAST(item_id AS VARCHAR) AS doc_id, text AS content FROM benchmark UNION ALL SELECT 'page_' || page_id, html FROM pages),
upserted AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT doc_id FROM changed) UNION ALL SELECT * FROM changed)"""


@query(f"WITH {UPSERT_SQL} SELECT doc_id, content FROM upserted")
def corpus_upsert(t: Tables) -> DataFrame:
    return collection.upsert(documents_table(t), changed_documents(t))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def corpus_delete(t: Tables) -> DataFrame:
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    return collection.delete(documents_table(t), toxic)


def change_events(t: Tables) -> DataFrame:
    """Three rounds of events: adds of all documents, replacements and new pages, deletes of toxic documents."""
    adds = documents_table(t).select(F.lit(1).cast("long").alias("seq"), F.lit("add").alias("op"), "doc_id", "content")
    later = changed_documents(t).select(F.lit(2).cast("long").alias("seq"), F.lit("add").alias("op"), "doc_id", "content")
    deletes = t.labels.filter("toxic = 1").select(
        F.lit(3).cast("long").alias("seq"), F.lit("delete").alias("op"), F.col("doc_id").cast("string").alias("doc_id"),
        F.lit(None).cast("string").alias("content"))
    events = adds.unionByName(later).unionByName(deletes)
    return events.withColumns({"metadata": F.lit(None).cast("map<string,string>"), "embedding": F.lit(None).cast("array<float>")})


CHANGED_SQL = f"""WITH {UPSERT_SQL}, live AS (SELECT * FROM upserted WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)),
live_words AS (SELECT doc_id, unnest(string_split(content, ' ')) AS term FROM live),
state AS (SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM live_words GROUP BY doc_id)"""


def index_state(index: Index) -> DataFrame:
    """Per live document its content and what the postings say about it."""
    parts = index.lexical.postings[0]
    for part in index.lexical.postings[1:]:
        parts = parts.unionByName(part)
    counts = parts.groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.count(F.lit(1)).alias("terms"))
    return index.corpus.select("doc_id", "content").join(counts, "doc_id")


@query(f"{CHANGED_SQL} SELECT doc_id, content, tokens, terms FROM live JOIN state USING (doc_id)")
def apply_changes(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "store")
    save_index(documents_table(t), path)
    return index_state(commit_changes(t.spark, path, change_events(t).filter("seq > 1")))


@query(f"{CHANGED_SQL} SELECT doc_id, content, tokens, terms FROM live JOIN state USING (doc_id)")
def stream_changes(t: Tables) -> DataFrame:
    events = scratch_dir(t.spark, "events")
    # One file set per round, so rounds may arrive in any order; as many files as a round's size needs.
    change_events(t).withColumn("round", F.col("seq")).hint("rebalance", "round").write.partitionBy("round").parquet(events)
    store, checkpoint = scratch_dir(t.spark, "store"), scratch_dir(t.spark, "checkpoint")
    finish(jobs.stream_changes(t.spark, events, store, checkpoint, max_files=4))
    return index_state(load_index(t.spark, store))


@query(f"""{CHANGED_SQL}, live_df AS (SELECT term, count(DISTINCT doc_id) AS df FROM live_words GROUP BY term),
live_totals AS (SELECT count(*) AS n, CAST(sum(tokens) AS BIGINT) AS total_dl FROM state)
SELECT n, total_dl, round(avg(ln(n - df + 0.5) - ln(df + 0.5)), 4) AS mean_idf FROM live_df, live_totals GROUP BY n, total_dl""")
def changed_statistics(t: Tables) -> DataFrame:
    store = scratch_dir(t.spark, "store")
    save_index(documents_table(t), store)
    index = commit_changes(t.spark, store, change_events(t).filter("seq > 1"))
    return index.lexical.stats.withColumn("mean_idf", F.round("mean_idf", 4))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content, len(string_split(text, ' ')) AS tokens,
len(list_distinct(string_split(text, ' '))) AS terms FROM documents""")
def index_duplicate_ids(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "store")
    return index_state(save_index(documents_table(t).unionByName(documents_table(t)), path))


def finish(run) -> None:
    run.awaitTermination()  # to the end of the input, however long; raises what the run raised


INGEST_SQL = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content, lang, len(string_split(text, ' ')) AS tokens,
(SELECT 1) AS once FROM documents"""


def ingested(index: Index) -> DataFrame:
    state = index_state(index).drop("terms")
    lang = index.corpus.select("doc_id", text.meta_get("metadata", "lang").alias("lang"))
    return state.join(lang, "doc_id").withColumn("once", F.lit(1))


@query(INGEST_SQL)
def ingest_files(t: Tables) -> DataFrame:
    files, store = scratch_dir(t.spark, "files"), scratch_dir(t.spark, "store")
    corpus_json.write_document_files(source_documents(t), files, "source")
    ingest_plan.ingest(t.spark, files, store, multi_line=False)
    return ingested(ingest_plan.ingest(t.spark, files, store, multi_line=False).index)  # the second run adds nothing


@query(INGEST_SQL)
def ingest_subfolders(t: Tables) -> DataFrame:
    """Two runs; both land files of equal base names in several folders."""
    files, store = scratch_dir(t.spark, "files"), scratch_dir(t.spark, "store")
    docs = source_documents(t)
    for i, lands in enumerate((F.col("type") == "en", F.col("type") != "en")):
        corpus_json.write_document_files(docs.filter(lands), f"{files}/run{i}", "source")
        index = ingest_plan.ingest(t.spark, files, store, multi_line=False).index
    return ingested(index)


@query("""SELECT CAST(doc_id AS VARCHAR) AS name, 'document' AS kind FROM documents WHERE lang <> 'es'
UNION ALL SELECT source, 'unreadable' FROM documents WHERE lang = 'es'
UNION ALL SELECT DISTINCT source, 'processed' FROM documents WHERE lang <> 'es'""")
def ingest_quarantine(t: Tables) -> DataFrame:
    """Spanish documents land as records of another shape."""
    files, store = scratch_dir(t.spark, "files"), scratch_dir(t.spark, "store")
    corpus_json.write_document_files(source_documents(t).filter("type <> 'es'"), f"{files}/good", "source")
    torn = t.documents.filter("lang = 'es'").select(F.substring("text", 1, 20).alias("documents"), "source")
    torn.write.partitionBy("source").json(f"{files}/torn")
    index, unreadable = ingest_plan.ingest(t.spark, files, store, multi_line=False)
    source = F.regexp_extract("file_name", "source=([^/]*)/", 1)
    rows = [index.corpus.select(F.col("doc_id").alias("name"), F.lit("document").alias("kind")),
            unreadable.select(source, F.lit("unreadable")),
            committed_files(t.spark, store).select(source).distinct().withColumn("kind", F.lit("processed"))]
    return rows[0].union(rows[1]).union(rows[2])


@query(INGEST_SQL)
def stream_ingest(t: Tables) -> DataFrame:
    files = scratch_dir(t.spark, "files")
    corpus_json.write_document_files(source_documents(t), files, "source")
    store, checkpoint = scratch_dir(t.spark, "store"), scratch_dir(t.spark, "checkpoint")
    finish(jobs.stream_ingest(t.spark, files, store, checkpoint, multi_line=False, max_files=8))
    return ingested(load_index(t.spark, store))


@query(f"{HITS_SQL} SELECT query_id, rank, doc_id, combined_score, vector_score, bm25_score FROM hits")
def stream_search(t: Tables) -> DataFrame:
    store, asked = scratch_dir(t.spark, "store"), scratch_dir(t.spark, "asked")
    out, checkpoint = scratch_dir(t.spark, "hits"), scratch_dir(t.spark, "checkpoint")
    save_index(corpus(t), store)
    questions(t).write.parquet(asked)
    finish(jobs.stream_search(t.spark, asked, store, out, checkpoint, K))
    return t.spark.read.parquet(out).select("query_id", "rank", "doc_id", "combined_score", "vector_score", "bm25_score")
