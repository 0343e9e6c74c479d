"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.centroids import cluster_vectors
from corpusmill.llm.chosen_path import linked_components
from corpusmill.llm.conversations import damaged_and_repaired
from corpusmill.llm.fingerprints import edited_fingerprints
from corpusmill.llm.language_model import score_documents
from corpusmill.llm.mixing import in_order, mix_sources
from corpusmill.llm.ngram_join import near_duplicates
from corpusmill.llm.packing import pack_documents
from corpusmill.llm.quality import score_quality, train_quality
from corpusmill.llm.secrets import BASE_KINDS, scan_secrets, spans_text
from corpusmill.llm.token_counts import count_tokens
from corpusmill.llm.topk import sorted_vectors, top_products
from corpusmill.llm.toxicity import score_toxicity, train_toxicity
from corpusmill.llm.words import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


NEAR_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS g FROM words),
classes AS (
  SELECT g, min(doc_id) AS copy_id, count(*) AS n_copies FROM sets GROUP BY g),
grams AS (SELECT copy_id, n_copies, len(g) AS n, unnest(g) AS gram FROM classes),
links AS MATERIALIZED (
  SELECT a.copy_id AS a, b.copy_id AS b, any_value(b.n_copies) AS copies
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.copy_id <> b.copy_id
  GROUP BY a.copy_id, b.copy_id
  HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8),
reached AS (
  SELECT copy_id AS node, copy_id AS label FROM classes
  UNION
  SELECT l.b, r.label FROM reached r JOIN links l ON l.a = r.node),
labels AS (SELECT node, min(label) AS class_id FROM reached GROUP BY node),
counts AS (SELECT a, sum(copies) AS n FROM links GROUP BY a)
SELECT s.doc_id, l.class_id, CAST(coalesce(k.n, 0) + c.n_copies - 1 AS BIGINT) AS n_links, c.copy_id, c.n_copies
FROM sets s JOIN classes c ON s.g = c.g JOIN labels l ON l.node = c.copy_id LEFT JOIN counts k ON k.a = c.copy_id
"""


@query(NEAR_SQL)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", "predicted")


@query()
def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query()
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS r, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.r <> c.r),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query(TOPK_SQL)
def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sorted_vectors(table(spark, sf_dir, "embeddings"))
    return top_products(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query()
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", "predicted")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
capped AS (
  SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
targets AS (
  SELECT source, source_size, place,
         least(cap, coalesce((SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, place LIMIT 1) * weight,
                             cap)) AS target
  FROM levels),
ordered AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.place,
         coalesce(sum(s.size) OVER (PARTITION BY t.place ORDER BY md5(concat_ws(':', s.doc_id, s.size)), s.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN least(floor(round(t.target) / t.source_size), 2) ELSE 0 END AS passes
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, greatest(0, least(size, round(target) - passes * source_size - before)) AS part FROM ordered)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken,
       CASE WHEN passes * size + part > 0 THEN round(CASE place % 3
         WHEN 0 THEN (sqrt(1.5 * 1.5 + 2 * -1.0 * (before / target)) - 1.5) / -1.0
         WHEN 1 THEN before / target
         ELSE (sqrt(0.5 * 0.5 + 2 * 1.0 * (before / target)) - 0.5) / 1.0 END, 9) END AS first_position
FROM mixed
"""


@query(MIX_SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents")).withColumn("position", F.get("positions", F.lit(0)))
    return in_order(mixed).select("doc_id", "size", "source_size", "target", "taken",
                        F.round("position", 9).alias("first_position"))


@query()
def op10_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s.kind.isin(*BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


COMPONENT_SQL = """
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [z[1] || ' ' || z[2] || ' ' || z[3] for z in list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:])] END)) AS g
  FROM words),
classes AS (SELECT g, min(r) AS class, min(doc_id) AS least, len(any_value(g)) AS n FROM sets WHERE len(g) > 0 GROUP BY g),
grams AS MATERIALIZED (SELECT class, n, gram FROM (SELECT class, n, unnest(g) AS gram FROM classes)
                       QUALIFY count(*) OVER (PARTITION BY gram) > 1),
above AS (
  SELECT a.class AS a, b.class AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.class < b.class
    AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.class, b.class
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS MATERIALIZED (SELECT a, b FROM above UNION ALL SELECT b, a FROM above),
reached AS (
  SELECT class AS node, class AS label FROM classes
  UNION
  SELECT l.b, r.label FROM reached r JOIN links l ON l.a = r.node),
components AS (
  SELECT r.node, min(c.least) AS component_id FROM reached r JOIN classes c ON c.class = r.label GROUP BY r.node),
found AS (
  SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles,
         CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE k.component_id END AS component_id
  FROM sets s LEFT JOIN classes c ON s.g = c.g LEFT JOIN components k ON k.node = c.class)
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM found
"""


@query(COMPONENT_SQL)
def op11_linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


def _cluster_sql(n_centroids: int = 40, rounds: int = 5) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
assigned{i} AS (
  SELECT k.r, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min({{'d': list_inner_product(k.v, k.v)
    + list_inner_product(c.c, c.c) - 2 * list_inner_product(k.v, c.c), 'n': c.cluster}}) AS best
  FROM kept k CROSS JOIN centroids{i} c GROUP BY k.r)""")
        if i < rounds:
            steps.append(f"""
means{i} AS (
  SELECT cluster, list(mean ORDER BY pos) AS c FROM (
    SELECT best.n AS cluster, pos, floor(sum(x) / count(*)) AS mean
    FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM assigned{i}) GROUP BY ALL) GROUP BY cluster),
centroids{i + 1} AS (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM centroids{i} o LEFT JOIN means{i} m ON m.cluster = o.cluster)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
centroids0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM kept QUALIFY cluster < {n_centroids}),{",".join(steps)},
measured AS (SELECT vec_id, best.n AS cluster, CAST(best.d AS BIGINT) AS distance FROM assigned{rounds})
SELECT m.vec_id, m.cluster, m.distance, CAST(sum(m.distance) OVER (PARTITION BY m.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string([x::BIGINT for x in c.c], ',')) AS centroid_sha256
FROM measured m JOIN centroids{rounds} c ON c.cluster = m.cluster
"""


@query(_cluster_sql())
def op12_cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


# Per role state: the audits and texts of inserts that may come before a row, and the state after them.
_INSERTS = {
    "''": [("", "", "''"), ("I", "user:\n", "'u'"), ("II", "user:\nassistant:\n", "'a'")],
    "'s'": [("", "", "'s'"), ("I", "user:\n", "'u'"), ("II", "user:\nassistant:\n", "'a'")],
    "'u'": [("", "", "'u'"), ("I", "assistant:\n", "'a'")],
    "'a'": [("", "", "'a'"), ("I", "user:\n", "'u'")],
}
_FOLLOWS = {"''": "su", "'s'": "u", "'u'": "a", "'a'": "u"}


def _repair_moves() -> str:
    """VALUES rows: state, edits, inserted text, cost, initial kept, role given, state after."""
    rows = []
    for state, inserts in _INSERTS.items():
        rows.append(f"({state}, 'D', '', 2, NULL, NULL, {state})")
        for edits, text, then in inserts:
            given = "assistant" if then == "'u'" else "user"
            rows.append(f"({state}, '{edits}R', '{text}', {5 * len(edits) + 1}, NULL, '{given}', '{given[0]}')")
            rows += [f"({state}, '{edits}K', '{text}', {5 * len(edits)}, '{r}', NULL, '{r}')" for r in _FOLLOWS[then]]
    return ", ".join(rows)


REPAIR_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)) ORDER BY i) AS t
  FROM range(256) r(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
faults AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT for c in string_split(key, '')]),
    lambda x, y: xor(x >> 8, t[CAST(xor(x & 255, y) AS BIGINT) + 1])), 4294967295::UBIGINT) % 20 AS fault
  FROM keyed CROSS JOIN crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faults WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS r, left(lag(role) OVER w, 1) AS r_before,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
rows AS MATERIALIZED (
  SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated,
         i > 1 AND r_before || r NOT IN ('su', 'ua', 'au') AS illegal
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed)),
moves(state, edits, inserted, cost, keeps, gives, next_state) AS (VALUES {_repair_moves()}),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, {{'cost': 0, 'audit': '', 'text': ''}} AS best FROM rows
  UNION ALL
  SELECT s.conv_id, s.i + 1, m.next_state, min({{
    'cost': s.best.cost + m.cost + CASE WHEN w.truncated AND m.edits <> 'D' THEN 5 ELSE 0 END,
    'audit': s.best.audit || m.edits,
    'text': s.best.text || m.inserted || CASE WHEN m.edits = 'D' THEN '' ELSE coalesce(m.gives, w.role) || ':' || w.text
                                         || chr(10) END}})
  FROM steps s JOIN rows w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.i + 1
  JOIN moves m ON m.state = s.state AND (m.edits = 'D' OR NOT (w.blank OR w.duplicate))
    AND (m.keeps IS NULL OR m.keeps = w.r)
  GROUP BY s.conv_id, s.i, m.next_state),
sizes AS (
  SELECT conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, sum(blank::INT) AS blank,
         sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated, sum(illegal::INT) AS illegal
  FROM rows GROUP BY conv_id),
ends AS (
  SELECT s.conv_id, min({{
    'cost': s.best.cost + CASE s.state WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END,
    'audit': s.best.audit || CASE s.state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
    'text': s.best.text || CASE s.state WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10)
                                        WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END}}) AS best
  FROM steps s JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.n = s.i GROUP BY s.conv_id)
SELECT c.conv_id, CAST(coalesce(z.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(z.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(z.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(z.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(z.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost,
       coalesce(e.best.audit, '') AS audit,
       sha256(coalesce(left(e.best.text, length(e.best.text) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query(REPAIR_SQL)
def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))
