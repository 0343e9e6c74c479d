"""Sources, cleaning, document building, grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import Tables, query
from corpusmill.functions import text
from corpusmill.operators import collection, documents, ordinals
from corpusmill.plans import ingest
from corpusmill.runtime import scratch_dir
from corpusmill.schema import DEMAND_DEPOSIT, MISSING, SOLDIER_SAVINGS, STRING_MAP, TIME_DEPOSIT
from corpusmill.sources import corpus_json, records, sheets
from corpusmill.sources.index_store import load_index, save_index, scan_corpus

KEYS = DEMAND_DEPOSIT.key_fields
BASE, TOP = KEYS[2], KEYS[3]
# Rows that are written come in sheets of so many keys.
SHEET_KEYS = 2000
DATA = ["은행", "상품명", BASE, TOP, "종류"]
SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"


def clean_sql(column: str) -> str:
    plain = f"replace(replace({column}, '▷', ''), '<br />', ' ')"
    return f"trim(regexp_replace({plain}, '{SPACE}', ' ', 'g'))"


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}|{SPACE}$', '', 'g')"


# --- product sheet: part ---------------------------------------------------------------------------


def product_sheet(t: Tables) -> DataFrame:
    """Parts as a product sheet; every cell a text, large sizes missing, the brand as source file."""
    return t.part.select(
        F.col("p_brand").alias("은행"), F.col("p_name").alias("상품명"),
        F.when(F.col("p_size") <= 45, F.col("p_size")).cast("string").alias(BASE),
        F.col("p_retailprice").cast("string").alias(TOP), F.col("p_type").alias("종류"),
        F.col("p_brand").alias("source_file"), F.col("p_partkey").alias("row_ordinal"))


SHEET_SQL = """
sheet AS (
  SELECT p_partkey AS row_ordinal, p_brand AS source_file, p_brand AS bank, p_name AS product, p_type AS kind,
         CASE WHEN p_size <= 45 THEN p_size END AS base, CAST(p_retailprice AS VARCHAR) AS top
  FROM part),
shown AS (
  SELECT row_ordinal, source_file, bank, product, kind, top,
         CASE WHEN base IS NULL THEN '정보 없음'
              WHEN bool_and(base IS NOT NULL) OVER (PARTITION BY source_file) THEN CAST(base AS VARCHAR)
              ELSE CAST(CAST(base AS DOUBLE) AS VARCHAR) END AS base
  FROM sheet)"""
CONTENT_SQL = (f"'은행: ' || bank || chr(10) || '상품명: ' || product || chr(10) || '{BASE}: ' || base || chr(10) || "
               f"'{TOP}: ' || top || chr(10) || '종류: ' || kind")
SUMMARY_SQL = (f"concat_ws(', ', '은행: ' || bank, '상품명: ' || product, "
               f"CASE WHEN base <> '정보 없음' THEN '{BASE}: ' || base END, '{TOP}: ' || top)")
ID_SQL = "printf('입출금자유예금_product_%03d', row_ordinal)"


@query("SELECT p_brand AS bank, p_name AS product_name, CASE WHEN p_size <= 45 THEN CAST(p_size AS VARCHAR) END AS base_rate, "
       "CAST(p_retailprice AS VARCHAR) AS top_rate, p_type AS kind FROM part")
def csv_product_scan(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "sheets")
    records.write_records_csv(product_sheet(t).select(*DATA), path)
    names = dict(zip(DATA, ["bank", "product_name", "base_rate", "top_rate", "kind"]))
    return sheets.read_products_csv(t.spark, path).select(*[documents.q(c).alias(n) for c, n in names.items()])


@query("""SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_ordinal,
p_brand AS bank, CAST(p_retailprice AS VARCHAR) AS first_rate, CAST(p_size AS VARCHAR) AS second_rate,
p_type || ', ' || p_name AS conditions FROM part""")
def two_level_header_scan(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "two-level")
    top = ["은행", "제공 금리(%)", "", "우대금리 조건"]
    sub = ["", "1개월 이상 ~ 3개월 미만", "3개월 이상 ~ 6개월 미만", ""]
    sheet = F.replace("p_brand", F.lit("#"), F.lit("_")).alias("sheet")
    quoted = F.concat(F.lit('"'), "p_type", F.lit(", "), "p_name", F.lit('"'))
    body = t.part.select(sheet, F.col("p_partkey").alias("place"), F.concat_ws(
        ",", "p_brand", F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"), quoted).alias("value"))
    heads = t.part.select(sheet).distinct().select("sheet", F.posexplode(F.array(
        F.lit(",".join(top)), F.lit(",".join(sub)))).alias("n", "value")).select("sheet", (F.col("n") - 2).alias("place"), "value")
    lines = heads.unionByName(body).repartition("sheet").sortWithinPartitions("sheet", "place")
    lines.select("sheet", "value").write.partitionBy("sheet").text(path)
    rows = sheets.read_two_level_csv(t.spark, f"{path}/*")
    return rows.select(
        F.replace(F.regexp_extract("source_file", "sheet=([^/]*)/", 1), F.lit("_"), F.lit("#")).alias("sheet"),
        "row_ordinal", F.col("은행").alias("bank"), documents.q("제공 금리(%) 1개월 이상 ~ 3개월 미만").alias("first_rate"),
        documents.q("3개월 이상 ~ 6개월 미만").alias("second_rate"), documents.q("우대금리 조건").alias("conditions"))


@query("SELECT CAST(conv_id AS VARCHAR) AS category, role AS item, text AS value FROM conversations")
def category_csv_scan(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "category")
    sheet = t.conversations.select(F.col("conv_id").cast("string").alias("카테고리"), F.col("role").alias("세부 항목"),
                                   F.col("text").alias("내용"))
    records.write_records_csv(sheet, path)
    return sheets.read_category_csv(t.spark, path).select("category", "item", "value")


def source_documents(t: Tables) -> DataFrame:
    """Documents in the document contract, the source as file."""
    return t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.lit(MISSING).alias("bank"),
        F.concat(F.lit("product "), "doc_id").alias("product_name"), F.col("lang").alias("type"),
        F.col("text").alias("content"), F.concat(F.lit("lang: "), "lang").alias("key_summary"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string")).alias("metadata"),
        "source")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, 'product ' || doc_id AS product_name, lang AS type, text AS content,
'lang: ' || lang AS key_summary, CAST(n_chars AS VARCHAR) AS n_chars, source FROM documents""")
def json_corpus_scan(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "corpus-json")
    corpus_json.write_document_files(source_documents(t), path, "source")
    read = corpus_json.read_corpus_json(t.spark, path, multi_line=False)
    return read.select("id", "product_name", "type", "content", "key_summary",
                       text.meta_get("metadata", "n_chars").alias("n_chars"),
                       F.regexp_extract("source_file", "source=([^/]*)/", 1).alias("source"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "custKey", c_name AS "name", CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment,
CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS VARCHAR) END AS balance FROM customer""")
def xml_item_scan(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "xml")
    items = t.customer.select(
        F.col("c_custkey").cast("string").alias("custKey"), F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).alias("balance"))
    items.write.format("xml").option("rootTag", "items").option("rowTag", "item").save(path)
    return records.read_xml_items(t.spark, path).select("custKey", "name", "segment", "balance")


@query("""WITH expected AS (SELECT unnest(range(1, CAST(ceil(count(*) / 2.0) AS BIGINT) + 1)) AS page_no FROM documents)
SELECT page_no FROM expected WHERE page_no NOT IN (SELECT page_id + 1 FROM pages)""")
def page_audit(t: Tables) -> DataFrame:
    total = t.documents.agg(F.count(F.lit(1)).alias("total"))
    return collection.missing_pages(t.pages.select((F.col("page_id") + 1).alias("page_no")), total, 2)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS base_date FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'""")
def base_date_range(t: Tables) -> DataFrame:
    kept = collection.filter_base_date(t.orders, "o_orderdate", "19970101", "19980630")
    return kept.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("base_date"))


@query(f"""WITH {SHEET_SQL} SELECT {ID_SQL} AS id, bank, product AS product_name, {CONTENT_SQL} AS content,
{SUMMARY_SQL} AS key_summary, bank || '.json' AS file FROM shown""")
def json_corpus_roundtrip(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "json-out")
    sheet = product_sheet(t).withColumn("source_file", F.concat(F.lit("/raw/"), "source_file", F.lit(".csv")))
    corpus_json.write_corpus_json(documents.build_documents(sheet, DEMAND_DEPOSIT), path)
    return corpus_json.read_written_json(t.spark, path).select("id", "bank", "product_name", "content", "key_summary", "file")


TIME = TIME_DEPOSIT.key_fields


@query(f"""SELECT printf('정기예금_product_%03d', row_number() OVER (ORDER BY p_partkey) - 1) AS doc_id,
'은행: ' || p_brand || chr(10) || '상품명: ' || p_name || chr(10) || '{TIME[2]}: ' || p_size || chr(10) || '{TIME[3]}: ' || CAST(p_retailprice AS VARCHAR)
|| chr(10) || '{TIME[4]}: 정보 없음' || chr(10) || '우대조건: ' || p_type || chr(10) || p_name AS content,
'은행: ' || p_brand || ', 상품명: ' || p_name || ', {TIME[2]}: ' || p_size || ', {TIME[3]}: ' || CAST(p_retailprice AS VARCHAR) AS key_summary,
p_brand AS bank FROM part""")
def time_deposit_ingest(t: Tables) -> DataFrame:
    """Sheets with line breaks inside cells, as documents, through the store."""
    path = scratch_dir(t.spark, "sheets")
    sheet = t.part.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select(
        F.col("p_brand").alias("은행"), F.col("p_name").alias("상품명"), F.col("p_size").cast("string").alias(TIME[2]),
        F.col("p_retailprice").cast("string").alias(TIME[3]), F.lit(None).cast("string").alias(TIME[4]),
        F.concat_ws("\n", "p_type", "p_name").alias("우대조건"))
    records.write_records_csv(sheet, path)
    return through_store(t, ingest.sheet_documents(t.spark, path, TIME_DEPOSIT))


def through_store(t: Tables, docs: DataFrame) -> DataFrame:
    store = scratch_dir(t.spark, "store")
    index = ingest.commit_documents(t.spark, store, docs.withColumn("file_name", F.lit("sheet")))
    return index.corpus.select("doc_id", "content", text.meta_get("metadata", "key_summary").alias("key_summary"),
                               text.meta_get("metadata", "은행", F.lit(MISSING)).alias("bank"))


@query("""SELECT printf('military_product_%03d', row_number() OVER (ORDER BY c_custkey) - 1) AS doc_id,
'은행: ' || c_name || chr(10) || '제공 금리(%) 1개월 이상 ~ 3개월 미만: ' || c_nationkey || chr(10) || '1년 6개월 이상 ~ 만기: ' || c_custkey || chr(10)
|| '우대금리 조건: ' || c_mktsegment || ' 이체' AS content,
'은행: ' || c_name || ', 제공 금리(%) 1개월 이상 ~ 3개월 미만: ' || c_nationkey || ', 1년 6개월 이상 ~ 만기: ' || c_custkey
|| ', 우대금리 조건: ' || c_mktsegment || ' 이체' AS key_summary, c_name AS bank FROM customer""")
def soldier_savings_ingest(t: Tables) -> DataFrame:
    """Sheets with two header rows and marked-up cells, as documents, through the store."""
    path = scratch_dir(t.spark, "two-level")
    # sheets of bounded size, named in the order of their rows, each with its two header rows
    sheet = F.lpad(F.floor(F.col("c_custkey") / SHEET_KEYS).cast("string"), 12, "0").alias("sheet")
    heads = t.customer.select(sheet).distinct().select("sheet", F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("place"), F.lit(line).alias("value")) for i, line in (
            (-2, "은행,제공 금리(%),,우대금리 조건"), (-1, ",1개월 이상 ~ 3개월 미만,1년 6개월 이상 ~ 만기,"))])).alias("h")).select(
                "sheet", "h.*")
    body = t.customer.select(sheet, F.col("c_custkey").cast("long").alias("place"), F.concat_ws(
        ",", "c_name", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"),
        F.concat(F.lit("▷"), "c_mktsegment", F.lit("<br />이체"))).alias("value"))
    lines = heads.unionByName(body).repartition("sheet").sortWithinPartitions("sheet", "place")
    lines.select("sheet", "value").write.partitionBy("sheet").text(path)
    return through_store(t, ingest.sheet_documents(t.spark, f"{path}/*", SOLDIER_SAVINGS))


@query("""SELECT CAST(item_id AS VARCHAR) AS id, text AS content, 'item ' || item_id AS name FROM benchmark""")
def json_multi_line_scan(t: Tables) -> DataFrame:
    """One indented file per item."""
    path = scratch_dir(t.spark, "indented")
    doc = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("content"),
                   F.create_map(F.lit("name"), F.concat(F.lit("item "), "item_id")).alias("metadata"))
    t.benchmark.select("item_id", F.array(doc).alias("documents")).write.partitionBy("item_id").option(
        "pretty", "true").json(path)
    read = corpus_json.read_corpus_json(t.spark, path)
    return read.select("id", "content", text.meta_get("metadata", "name").alias("name"))


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","segment":' ||
CASE WHEN c_mktsegment <> 'BUILDING' THEN '"' || c_mktsegment || '"' ELSE 'null' END || '}' AS json FROM customer""")
def documents_json(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return rows.select("c_custkey", text.documents_json("c_custkey", "c_name", "segment").alias("json"))


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer""")
def from_xml(t: Tables) -> DataFrame:
    segment = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("<segment>"), "c_mktsegment", F.lit("</segment>"))).otherwise("")
    xml = F.concat(F.lit("<item><name>"), "c_name", F.lit("</name>"), segment, F.lit("</item>"))
    rows = t.customer.select("c_custkey", xml.alias("xml")).withColumn("item", text.from_xml("xml", "name string, segment string"))
    return rows.select("c_custkey", "item.name", "item.segment")


@query("SELECT conv_id, turn, role, text FROM conversations")
def csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "csv-out")
    records.write_records_csv(t.conversations, path)
    return records.read_records_csv(t.spark, path, t.conversations.schema)


def plain_corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"),
                              F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))


@query("""WITH words AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, ' ')) AS term FROM documents)
SELECT w.doc_id, count(DISTINCT term) AS terms, count(*) AS tokens, max(k.doc_key) AS doc_key FROM words w
JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(sha1(text), 1, 20) AS doc_key FROM documents) k ON k.doc_id = w.doc_id GROUP BY w.doc_id""")
def index_roundtrip(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "index")
    save_index(plain_corpus(t), path)
    index = load_index(t.spark, path)
    per_doc = index.lexical.postings[0].groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"))
    return per_doc.join(index.corpus.select("doc_id", "doc_key"), "doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content, lang FROM documents")
def corpus_scan(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "index")
    save_index(plain_corpus(t), path)
    return scan_corpus(load_index(t.spark, path)).select("doc_id", "content", text.meta_get("metadata", "lang").alias("lang"))


@query("""SELECT event_id, event_type <> 'error' AS readable,
CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '"k": (-?[0-9]+)', 1) AS BIGINT) END AS k FROM events""")
def quarantine_split(t: Tables) -> DataFrame:
    broken = F.when(F.col("event_type") == "error", F.lit('{"k": ')).otherwise(F.col("props"))
    good, bad = corpus_json.quarantine_split(t.events.select("event_id", broken.alias("props")), "props", "k bigint")
    return good.select("event_id", F.lit(True).alias("readable"), "k").unionByName(
        bad.select("event_id", F.lit(False).alias("readable"), F.lit(None).cast("bigint").alias("k")))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(\\.*[^.].*)\\.[^.]*$', '\\1') || '.json' AS file_name FROM pages""")
def source_basename(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.output_name("url").alias("file_name"))


# --- projections -----------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand FROM part")
def drop_unnamed_columns(t: Tables) -> DataFrame:
    sheet = t.part.select("p_partkey", F.col("p_size").alias("Unnamed: 1"), "p_name", F.col("p_type").alias("_c3"), "p_brand")
    return documents.drop_unnamed(sheet)


@query(f"WITH {SHEET_SQL} SELECT row_ordinal, bank, product, coalesce(CAST(base AS VARCHAR), '정보 없음') AS base, top, kind FROM sheet")
def fill_missing_sentinel(t: Tables) -> DataFrame:
    names = dict(zip(DATA, ["bank", "product", "base", "top", "kind"]))
    filled = documents.fill_missing(product_sheet(t).select("row_ordinal", *[documents.q(c).alias(n) for c, n in names.items()]),
                                    columns=list(names.values()))
    return filled


@query(f"SELECT doc_id, {clean_sql(chr(39) + '▷ ' + chr(39) + ' || text || ' + chr(39) + '<br />' + chr(39) + ' || lang')} AS text FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.clean_text(F.concat(F.lit("▷ "), "text", F.lit("<br />"), "lang")).alias("text"))


@query(f"SELECT page_id, {clean_sql(chr(39) + '▷' + chr(39) + ' || url')} AS url, {clean_sql('replace(html, ' + chr(39) + '<br>' + chr(39) + ', ' + chr(39) + '<br />' + chr(39) + ')')} AS html FROM pages")
def clean_all_columns(t: Tables) -> DataFrame:
    raw = t.pages.select("page_id", F.concat(F.lit("▷"), "url").alias("url"),
                         F.replace("html", F.lit("<br>"), F.lit("<br />")).alias("html"))
    return documents.clean_columns(raw, ["url", "html"])


@query(f"WITH {SHEET_SQL} SELECT row_ordinal, {CONTENT_SQL} AS content FROM shown")
def narrative_content(t: Tables) -> DataFrame:
    shown = documents.fill_missing(documents.render_numbers(product_sheet(t), DATA), columns=DATA)
    return shown.select("row_ordinal", documents.narrative(DATA).alias("content"))


@query(f"WITH {SHEET_SQL} SELECT row_ordinal, {SUMMARY_SQL} AS key_summary FROM shown")
def key_summary(t: Tables) -> DataFrame:
    shown = documents.fill_missing(documents.render_numbers(product_sheet(t), DATA), columns=DATA)
    return shown.select("row_ordinal", documents.key_summary(DATA, KEYS).alias("key_summary"))


@query(f"""WITH {SHEET_SQL} SELECT {ID_SQL} AS id, bank, product AS product_name, '입출금자유예금' AS type,
{CONTENT_SQL} AS content, {SUMMARY_SQL} AS key_summary, source_file FROM shown""")
def build_documents(t: Tables) -> DataFrame:
    return documents.build_documents(product_sheet(t), DEMAND_DEPOSIT).drop("metadata")


@query("SELECT p_partkey, printf('정기예금_product_%03d', p_partkey) AS id FROM part")
def document_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.doc_id("정기예금_product", "p_partkey").alias("id"))


@query(f"""WITH {SHEET_SQL}, docs AS (SELECT {ID_SQL} AS id, {SUMMARY_SQL} AS key_summary, bank, product, base, top, kind FROM shown)
SELECT id, '은행' AS key, bank AS value FROM docs UNION ALL SELECT id, '상품명', product FROM docs
UNION ALL SELECT id, '{BASE}', base FROM docs UNION ALL SELECT id, '{TOP}', top FROM docs
UNION ALL SELECT id, '종류', kind FROM docs UNION ALL SELECT id, 'key_summary', key_summary FROM docs""")
def metadata_entries(t: Tables) -> DataFrame:
    docs = documents.build_documents(product_sheet(t), DEMAND_DEPOSIT)
    return docs.select("id", F.explode("metadata").alias("key", "value"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS short FROM documents")
def truncate_ellipsis(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.ellipsis("text").alias("short"))


@query("SELECT doc_id, text AS content, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS entries FROM documents WHERE n_chars >= 100")
def valid_documents(t: Tables) -> DataFrame:
    raw = t.documents.select(
        "doc_id", F.when(F.col("n_chars") >= 100, F.col("text")).alias("content"),
        F.when(F.col("lang") != "en", F.create_map(F.lit("lang"), F.col("lang"))).alias("metadata"))
    return documents.valid_documents(raw).select("doc_id", "content", F.size("metadata").alias("entries"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en-' || doc_id ELSE substr(sha1(text), 1, 20) END AS doc_key FROM documents")
def document_key(t: Tables) -> DataFrame:
    own = F.when(F.col("lang") == "en", F.create_map(F.lit("id"), F.concat(F.lit("en-"), "doc_id"))).otherwise(
        F.create_map().cast(STRING_MAP))
    return t.documents.select("doc_id", text.doc_key(own, "text").alias("doc_key"))


@query("""SELECT event_id, 'k' AS key, regexp_extract(props, '"k": (-?[0-9]+)', 1) AS value FROM events WHERE event_type <> 'view'""")
def metadata_from_json(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("props"))
    return t.events.select("event_id", F.explode(text.metadata_from_json(raw)).alias("key", "value"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'ECONOMY' AND contains(p_name, 'ring')")
def attribute_search(t: Tables) -> DataFrame:
    return collection.attribute_search(t.part, {"p_type": "ECONOMY"}, {"p_name": "ring"}).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_rate_products(t: Tables) -> DataFrame:
    return collection.top_rate_products(t.part, "p_retailprice", "p_partkey", 10).select("p_partkey", "p_name", "p_retailprice")


# --- grouping, ordinals ----------------------------------------------------------------------------


def category_rows(t: Tables) -> DataFrame:
    return documents.clean_category_rows(t.conversations.select(
        F.col("conv_id").cast("string").alias("category"), F.col("role").alias("item"), F.col("text").alias("value"),
        F.col("turn").alias("row_ordinal")))


CATEGORY_SQL = f"""rows AS (SELECT CAST(conv_id AS VARCHAR) AS category, role AS item, {clean_sql('text')} AS value, turn FROM conversations)"""
CATEGORY_SUMMARY_SQL = """summary AS (SELECT category, string_agg(item || ': ' || CASE WHEN length(value) > 50 THEN substr(value, 1, 50) || '...' ELSE value END, ', ' ORDER BY turn) AS key_summary
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY turn) AS n FROM rows) WHERE n <= 2 GROUP BY category)"""
CATEGORY_NUMBER_SQL = "numbers AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS ordinal FROM (SELECT DISTINCT category FROM rows))"


@query(f"""WITH {CATEGORY_SQL}, {CATEGORY_SUMMARY_SQL}, {CATEGORY_NUMBER_SQL},
body AS (SELECT category, string_agg(item || ': ' || value, chr(10) ORDER BY turn) AS lines FROM rows GROUP BY category),
items AS (SELECT category, count(DISTINCT item) AS n FROM rows GROUP BY category)
SELECT printf('military_desc_%03d', ordinal) AS id, '정보 없음' AS bank, category AS product_name, '장병내일준비적금 상품설명' AS type,
CAST(0 AS BIGINT) AS part, '카테고리: ' || category || chr(10) || lines AS content, key_summary, n + 1 AS entries
FROM body JOIN summary USING (category) JOIN numbers USING (category) JOIN items USING (category)""")
def category_documents(t: Tables) -> DataFrame:
    docs = documents.category_documents(category_rows(t))
    return docs.withColumn("entries", F.size("metadata").cast("long")).drop("metadata")


@query(f"""WITH {CATEGORY_SQL}, {CATEGORY_NUMBER_SQL}
SELECT printf('military_desc_%03d', ordinal) AS doc_id, '카테고리: ' || category || chr(10) || string_agg(item || ': ' || value, chr(10) ORDER BY turn) AS content
FROM rows JOIN numbers USING (category) GROUP BY category, ordinal""")
def category_ingest(t: Tables) -> DataFrame:
    """Every line of every category comes back from the store."""
    return through_store(t, documents.category_documents(category_rows(t))).select("doc_id", "content")


@query(f"""WITH {CATEGORY_SQL} SELECT category, item, CAST(0 AS BIGINT) AS part, string_agg(value, ' / ' ORDER BY turn) AS value
FROM rows GROUP BY category, item""")
def category_metadata(t: Tables) -> DataFrame:
    return documents.category_metadata(documents.with_part(category_rows(t), None))


@query(f"WITH {CATEGORY_SQL}, {CATEGORY_SUMMARY_SQL} SELECT category, key_summary FROM summary")
def category_key_summary(t: Tables) -> DataFrame:
    return documents.category_summary(category_rows(t))


@query(f"WITH {CATEGORY_SQL}, {CATEGORY_NUMBER_SQL} SELECT category, ordinal FROM numbers")
def category_ordinal(t: Tables) -> DataFrame:
    return ordinals.key_ordinal(category_rows(t), "category", "ordinal")


@query("SELECT p_partkey, p_brand AS source_file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_ordinal FROM part")
def row_ordinal(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_brand").alias("source_file"))
    return ordinals.row_ordinal(rows, "source_file", ["p_partkey"])


# --- collection ------------------------------------------------------------------------------------


@query("SELECT 'doc_' || doc_id || '.json' AS file_name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ledger_new_files(t: Tables) -> DataFrame:
    return collection.new_files(file_names(t.documents), file_names(t.labels))


@query("SELECT 'doc_' || doc_id || '.json' AS file_name FROM documents UNION SELECT 'doc_' || doc_id || '.json' FROM labels")
def ledger_append(t: Tables) -> DataFrame:
    return collection.append_ledger(file_names(t.labels), file_names(t.documents))


def file_names(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("doc_"), "doc_id", F.lit(".json")).alias("file_name"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content, lang, NULL AS url FROM documents
UNION ALL SELECT 'page_' || page_id, html, NULL, url FROM pages""")
def corpus_union(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), "lang")
    pages = t.pages.select(F.concat(F.lit("page_"), "page_id").alias("doc_id"), F.col("html").alias("content"), "url")
    return collection.union_corpora(docs, pages)


@query(f"""SELECT sha1({clean_sql('text')}) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def dedup_exact(t: Tables) -> DataFrame:
    return collection.dedup_exact(t.documents, "doc_id", "text")


@query("SELECT source AS source_file, count(*) AS documents FROM documents GROUP BY ROLLUP (source)")
def ingest_report(t: Tables) -> DataFrame:
    return collection.ingest_report(t.documents.withColumnRenamed("source", "source_file"))


@query("SELECT count(*) AS documents, count(*) FILTER (lang = 'es') AS null_metadata FROM documents")
def corpus_health(t: Tables) -> DataFrame:
    raw = t.documents.select("doc_id", F.when(F.col("lang") != "es", F.create_map(F.lit("lang"), F.col("lang"))).alias("metadata"))
    return collection.corpus_health(raw)
