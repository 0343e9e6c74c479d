import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import documents, ordinals
from corpusmill.plans.ingest import commit_documents, ingest, sheet_documents
from corpusmill.runtime import lookup_join, scratch_dir, top_per_group
from corpusmill.schema import (
    DEMAND_DEPOSIT, MISSING, SOLDIER_SAVINGS, SOLDIER_SAVINGS_GUIDE, TIME_DEPOSIT, SheetSpec,
)
from corpusmill.sources import corpus_json, records, sheets
from corpusmill.sources.index_store import committed_files, load_index


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("▷급여<br />이체\n 추가 ", "급여 이체 추가"),
    ("a<br>b", "a<br>b"),
    ("a　 \xa0b\x1cc", "a b c"),
    ("  ", ""),
])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


@pytest.mark.parametrize("raw, want", [
    ("a##[USER_ANSWER]: b ##[USER_ANSWER]: c", "b ##[USER_ANSWER]: c"),
    (" no marker\n", "no marker"),
    ("##[USER_ANSWER]:", ""),
])
def test_extract_answer(spark, raw, want):
    assert one(spark, raw, text.extract_answer) == want


@pytest.mark.parametrize("raw, want", [("a  b ", ["a", "", "b", ""]), ("", [""]), ("a\nb c", ["a\nb", "c"])])
def test_tokens(spark, raw, want):
    assert one(spark, raw, text.tokens) == want


@pytest.mark.parametrize("n", [49, 50, 51])
def test_ellipsis(spark, n):
    assert one(spark, "가" * n, text.ellipsis) == ("가" * n if n <= 50 else "가" * 50 + "...")


@pytest.mark.parametrize("raw", ["2.70", "3", "1e7", "12345678.9", "0.0001", "0.00001", "1e15", "1e16", "1.5e300", "-0.5",
                                 "123456789012345680", "0.00012345678901234567"])
def test_floats_print_as_python_does(spark, raw):
    assert one(spark, raw, lambda c: text.python_float(c.cast("double"))) == str(float(raw))


@pytest.mark.parametrize("path, want", [
    ("/raw/예금_2025.csv", "예금_2025.json"), ("a.b.csv", "a.b.json"), ("/x/noext", "noext.json"),
    (".hidden", ".hidden.json"), ("a..csv", "a..json"),
])
def test_output_name(spark, path, want):
    assert one(spark, path, text.output_name) == want


def test_document_key(spark):
    df = spark.createDataFrame([Row(m={"id": "own"}, c="x"), Row(m={"other": "1"}, c="가나")])
    assert [r[0] for r in df.select(text.doc_key("m", "c")).collect()] == ["own", "3ca97889c86d483cf3a8"]


def test_prompt_keeps_braces_of_the_texts(spark):
    prompt = one(spark, "why {context}?", lambda c: text.build_prompt(c, F.lit("{question} data")))
    assert "## User Query:\n    why {context}?\n" in prompt and "Product Data:\n    {question} data\n" in prompt


def test_json_text_keeps_nulls_and_letters(spark):
    df = spark.createDataFrame([("가", None, {"k": "값"})], "id string, bank string, metadata map<string,string>")
    assert df.select(text.documents_json("id", "bank", "metadata")).first()[0] == '{"id":"가","bank":null,"metadata":{"k":"값"}}'


def test_xml_text_to_columns(spark):
    parsed = one(spark, "<item><a>1</a><b>x y</b></item>", lambda c: text.from_xml(c, "a string, b string, c string"))
    assert parsed.asDict() == {"a": "1", "b": "x y", "c": None}


def test_metadata_json(spark):
    for raw, want in ((" ", {}), (None, {}), ('{"a": 1, "b": "x"}', {"a": "1", "b": "x"})):
        assert one(spark, raw, text.metadata_from_json) == want


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")


def test_flat_sheet(spark, tmp_path):
    lines = ["은행,상품명,기본금리( %),\"최고금리(우대금리포함,  %)\",,Unnamed: 0"]
    lines += [f"{'ABCDEFGH'[i]}은행,{'가나다라마바사아'[i]} 예금,{2 + i / 10:.2f},{'' if i == 7 else i}.0,x,y".replace(",.0,", ",,")
              for i in range(8)]
    write(tmp_path / "sheet.csv", "\n".join(lines) + "\n")
    rows = sheets.read_products_csv(spark, str(tmp_path))
    docs = {r.id: r for r in documents.build_documents(rows, DEMAND_DEPOSIT).collect()}
    assert sorted(docs) == [f"입출금자유예금_product_{i:03d}" for i in range(8)]
    last = docs["입출금자유예금_product_007"]
    assert last.content == "은행: H은행\n상품명: 아 예금\n기본금리( %): 2.7\n최고금리(우대금리포함,  %): 정보 없음"
    assert last.key_summary == "은행: H은행, 상품명: 아 예금, 기본금리( %): 2.7"
    assert last.metadata == {"은행": "H은행", "상품명": "아 예금", "기본금리( %)": "2.7",
                             "최고금리(우대금리포함,  %)": MISSING, "key_summary": last.key_summary}
    assert (last.bank, last.product_name, last.type) == ("H은행", "아 예금", "입출금자유예금")


def test_number_columns_are_judged_per_file(spark, tmp_path):
    write(tmp_path / "a.csv", "은행,n,m\nA,1,1\nB,2,x\n")
    write(tmp_path / "b.csv", "은행,n,m\nC,1,1\nD,,2.50\n")
    spec = SheetSpec("t", "p", ("은행", "n", "m"))
    got = {r.bank: r.key_summary for r in documents.build_documents(sheets.read_products_csv(spark, str(tmp_path)), spec).collect()}
    assert got == {"A": "은행: A, n: 1, m: 1", "B": "은행: B, n: 2, m: x", "C": "은행: C, n: 1.0, m: 1.0",
                   "D": "은행: D, m: 2.5"}


def test_sheets_bind_columns_by_their_own_header(spark, tmp_path):
    write(tmp_path / "a.csv", "은행,상품명\nA,x\n")
    write(tmp_path / "b.csv", "상품명,은행\ny,B\n")
    rows = sheets.read_products_csv(spark, str(tmp_path)).orderBy("은행").collect()
    assert [(r["은행"], r["상품명"], r.row_ordinal) for r in rows] == [("A", "x", 0), ("B", "y", 0)]


@pytest.mark.parametrize("header", ["은행,이름", "은행", "은행,상품명,금리"])
def test_sheets_with_different_headers_are_refused(spark, tmp_path, header):
    write(tmp_path / "a.csv", "은행,상품명\nA,x\n")
    write(tmp_path / "b.csv", header + "\nx,A,1\n")
    with pytest.raises(ValueError, match="header|columns"):
        sheets.read_products_csv(spark, str(tmp_path)).collect()


def test_two_level_sheets_of_different_column_order(spark, tmp_path):
    write(tmp_path / "a.csv", "은행,금리,\n,단기,장기\nA,1,2\n")
    write(tmp_path / "b.csv", "금리,,은행\n단기,장기,\n3,4,B\n")
    rows = sheets.read_two_level_csv(spark, str(tmp_path)).orderBy("은행").collect()
    assert [(r["은행"], r["금리 단기"], r["장기"]) for r in rows] == [("A", "1", "2"), ("B", "3", "4")]


def test_category_sheet_of_another_column_order(spark, tmp_path):
    write(tmp_path / "a.csv", "내용,카테고리,세부 항목\nv,c,i\n")
    row = sheets.read_category_csv(spark, str(tmp_path)).first()
    assert (row.category, row["item"], row.value) == ("c", "i", "v")
    write(tmp_path / "b" / "b.csv", "내용,카테고리\nv,c\n")
    with pytest.raises(ValueError, match="세부 항목"):
        sheets.read_category_csv(spark, str(tmp_path / "b"))


def test_rows_without_a_file_are_kept(spark):
    rows = spark.createDataFrame([("1.50", None), ("2", "f"), ("x", "")], "rate string, source_file string")
    shown = documents.render_numbers(rows, ["rate"]).collect()
    assert {(r.rate, r.source_file) for r in shown} == {("1.5", None), ("2", "f"), ("x", "")}


def test_missing_key_fields_and_columns(spark, tmp_path):
    write(tmp_path / "s.csv", "비고\n-\nNA\n")
    docs = documents.build_documents(sheets.read_products_csv(spark, str(tmp_path)), TIME_DEPOSIT).orderBy("id").collect()
    assert [(d.bank, d.product_name, d.key_summary, d.content) for d in docs] == [
        (MISSING, MISSING, MISSING, "비고: -"), (MISSING, MISSING, MISSING, f"비고: {MISSING}")]


def test_source_column_named_key_summary_is_replaced(spark):
    df = spark.createDataFrame([("A", "old", 0)], "`은행` string, key_summary string, row_ordinal long")
    doc = documents.build_documents(df, TIME_DEPOSIT, extra=(), render=False).first()
    assert doc.metadata == {"은행": "A", "key_summary": "은행: A"}


def test_two_level_sheet(spark, tmp_path):
    write(tmp_path / "two.csv",
          "은행,제공 금리(%),,,우대금리 조건,\n"
          ",1개월 이상 ~ 3개월 미만,3개월 이상 ~ 6개월 미만,1년 6개월 이상 ~ 만기,,\n"
          'A은행,2.70,2.80,5.00,"▷급여<br />이체\n 추가 ",\n'
          "B은행,2.75,,4.5,없음,\n")
    docs = sheet_documents(spark, str(tmp_path), SOLDIER_SAVINGS).orderBy("id").collect()
    assert docs[0].id == "military_product_000" and docs[0].product_name == "A은행"
    assert docs[0].content == ("은행: A은행\n제공 금리(%) 1개월 이상 ~ 3개월 미만: 2.7\n3개월 이상 ~ 6개월 미만: 2.8\n"
                               "1년 6개월 이상 ~ 만기: 5.0\n우대금리 조건: 급여 이체 추가")
    assert docs[0].key_summary == ("은행: A은행, 제공 금리(%) 1개월 이상 ~ 3개월 미만: 2.7, 1년 6개월 이상 ~ 만기: 5.0, "
                                   "우대금리 조건: 급여 이체 추가")
    assert docs[1].metadata["3개월 이상 ~ 6개월 미만"] == MISSING


def test_flatten_header_carries_blank_tops():
    assert sheets.flatten_header(["a", None, " ", "b"], [None, "x", "y", " "]) == ["a", "x", "y", "b"]
    assert sheets.flatten_header(["a", " "], ["s", "t"]) == ["a s", "a t"]
    assert sheets.flatten_header(["a", None], ["s", None]) == ["a s", ""]


GUIDE = "카테고리,세부 항목,내용\n나,x,1\n가,x,1\n가,x,2\n가,y," + "z" * 51 + "\n"


def test_category_sheet(spark, tmp_path):
    write(tmp_path / "guide.csv", GUIDE)
    first, second = sheet_documents(spark, str(tmp_path), SOLDIER_SAVINGS_GUIDE).orderBy("id").collect()
    assert first.id == "military_desc_000" and first.product_name == "가" and first.bank == MISSING
    assert first.content == "카테고리: 가\nx: 1\nx: 2\ny: " + "z" * 51
    assert first.metadata == {"x": "1 / 2", "y": "z" * 51, "key_summary": "x: 1, x: 2"}
    assert second.id == "military_desc_001" and second.key_summary == "x: 1"


def category_rows(spark, n):
    return spark.range(n).select(F.lit("가").alias("category"), (F.col("id") % 3).cast("string").alias("item"),
                                 F.col("id").cast("string").alias("value"), F.col("id").alias("row_ordinal"))


def test_large_category_is_one_document(spark):
    doc = documents.category_documents(category_rows(spark, 2500)).collect()
    assert len(doc) == 1 and doc[0].part == 0
    assert doc[0].content == "카테고리: 가\n" + "\n".join(f"{i % 3}: {i}" for i in range(2500))


def test_category_in_several_documents_loses_nothing_in_the_store(spark, tmp_path):
    docs = documents.category_documents(category_rows(spark, 25), lines_per_document=10)
    commit_documents(spark, str(tmp_path / "s"), docs.withColumn("file_name", F.lit("f")))
    kept = load_index(spark, str(tmp_path / "s")).corpus.orderBy("doc_id").collect()
    assert [d.doc_id for d in kept] == ["military_desc_000", "military_desc_000_1", "military_desc_000_2"]
    lines = [line for d in kept for line in d.content.split("\n")[1:]]
    assert lines == [f"{i % 3}: {i}" for i in range(25)]
    assert kept[1].metadata["0"] == "12 / 15 / 18" and kept[1].metadata["key_summary"] == "1: 10, 2: 11"


def test_row_ordinals_over_many_partitions(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"), "id")
    got = ordinals.row_ordinal(df.repartition(13), "k", ["id"]).collect()
    expected = {}
    for r in sorted(got, key=lambda r: r.id):
        expected.setdefault(r.k, []).append(r.row_ordinal)
    assert all(v == list(range(len(v))) for v in expected.values()) and len(expected["hot"]) == 700


def test_file_ordinals_of_a_split_file(spark, tmp_path):
    write(tmp_path / "big.csv", "v\n" + "".join(f"{i}\n" for i in range(200_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = sheets.read_products_csv(spark, str(tmp_path), multi_line=False)
        assert rows.rdd.getNumPartitions() > 5
        assert rows.filter(F.col("v").cast("long") != F.col("row_ordinal")).count() == 0
        assert rows.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hot_keys_are_spread_without_changing_the_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(0, 50, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, ["k"], how).collect()
        spread = lookup_join(left, right, ["k"], how, spread=["id"], small=False, hot_rows=300).collect()
        assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, spread), key=str)


def test_top_per_group_beyond_the_group_limit(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), "id")
    top = top_per_group(df, ["g"], [F.col("id").desc()], 1500, ["id"])
    assert top.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("m")).orderBy("g").collect() == [
        Row(g=0, n=1500, m=3000), Row(g=1, n=1500, m=3001)]


def test_bad_files_are_set_aside(spark, tmp_path):
    doc = {"id": "a", "bank": "B", "product_name": "p", "type": "t", "content": "c", "key_summary": "k",
           "metadata": {"rate": 2.5, "name": "n"}}
    write(tmp_path / "good.json", json.dumps({"documents": [doc, {"id": "no content"}]}, ensure_ascii=False, indent=2))
    write(tmp_path / "bad.json", '{"documents": [')
    good, bad = corpus_json.read_with_quarantine(spark, str(tmp_path))
    assert {r.id for r in good.collect()} == {"a", "no content"}
    assert [r.source_file.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]

    store = scratch_dir(spark, "store")
    index, unreadable = ingest(spark, str(tmp_path), store)
    assert [r.file_name for r in unreadable.collect()] == ["bad.json"]
    assert [(r.doc_id, r.metadata) for r in index.corpus.collect()] == [("a", {"rate": "2.5", "name": "n"})]
    # the same file name is not read again, a new one is
    doc["content"] = "changed"
    write(tmp_path / "good.json", json.dumps({"documents": [doc]}))
    assert ingest(spark, str(tmp_path), store).index.corpus.first().content == "c"
    write(tmp_path / "newer.json", json.dumps({"documents": [doc]}))
    assert ingest(spark, str(tmp_path), store).index.corpus.first().content == "changed"
    # a mended file is read
    write(tmp_path / "bad.json", json.dumps({"documents": [doc | {"id": "b"}]}))
    assert {r.doc_id for r in ingest(spark, str(tmp_path), store).index.corpus.collect()} == {"a", "b"}


def test_equal_base_names_and_half_broken_files(spark, tmp_path):
    line = lambda i: json.dumps({"documents": [{"id": i, "content": f"text {i}"}]}) + "\n"
    store = scratch_dir(spark, "store")
    write(tmp_path / "f1" / "part.json", line("a"))
    ingest(spark, str(tmp_path), store, multi_line=False)
    write(tmp_path / "f2" / "part.json", line("b") + '{"documents": [\n' + line("c"))
    index, unreadable = ingest(spark, str(tmp_path), store, multi_line=False)
    assert {r.doc_id for r in index.corpus.collect()} == {"a", "b", "c"}
    assert [r.file_name for r in unreadable.collect()] == ["f2/part.json"]
    assert {r.file_name for r in committed_files(spark, store).collect()} == {"f1/part.json"}


def test_last_place_of_an_id_counts(spark, tmp_path):
    doc = lambda text: {"id": "a", "content": text}
    write(tmp_path / "1.json", json.dumps({"documents": [doc("z"), doc("y")]}))
    write(tmp_path / "0.json", json.dumps({"documents": [doc("zz")]}))
    index = ingest(spark, str(tmp_path), scratch_dir(spark, "store")).index
    assert [r.content for r in index.corpus.collect()] == ["y"] and index.lexical.totals["n"] == 1


def test_xml_pages(spark, tmp_path):
    page = "<response><body><totalCount>5</totalCount><items>{}</items></body></response>"
    write(tmp_path / "1.xml", page.format("<item><a>1</a><b>x</b></item><item><a>2</a></item>"))
    write(tmp_path / "3.xml", page.format("<item><a>3</a><c>007</c></item>"))
    rows = records.read_xml_items(spark, str(tmp_path)).orderBy("a").collect()
    assert [r.asDict() for r in rows] == [{"a": "1", "b": "x", "c": None}, {"a": "2", "b": None, "c": None},
                                          {"a": "3", "b": None, "c": "007"}]
    from corpusmill.operators.collection import missing_pages

    landed = spark.createDataFrame([(1,), (3,)], "page_no long")
    assert [r[0] for r in missing_pages(landed, records.read_page_totals(spark, str(tmp_path)), 2).collect()] == [2]
    assert missing_pages(landed, 0, 2).count() == 0


def test_a_brand_is_one_sheet_however_wide_its_keys(spark, tmp_path):
    from checks import document_queries  # noqa: F401
    from checks.registry import QUERIES

    rows = [(k, f"part, {k}", f"Brand#{k % 2}", "STEEL", k % 50, 1.5) for k in (1, 2, 1999, 2000, 4001, 90_000)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
                          ).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["two_level_header_scan"](spark, str(tmp_path)).collect()
    assert sorted((r.sheet, r.row_ordinal) for r in found) == [(f"Brand#{b}", i) for b in (0, 1) for i in range(3)]


def test_a_task_writes_a_bounded_share_of_documents(spark, monkeypatch):
    from corpusmill.schema import DOCUMENT
    from corpusmill.sources import corpus_json

    monkeypatch.setattr(corpus_json, "TASK_CONTENT", 1000)
    rows = spark.range(400).select(*[
        F.create_map(F.lit("n"), F.col("id").cast("string")).alias("metadata") if f.name == "metadata"
        else F.concat(F.lit(f"{f.name} "), "id").alias(f.name) for f in DOCUMENT.fields], F.lit("/raw/one.csv").alias("source_file"))
    path = scratch_dir(spark, "json-out")
    corpus_json.write_corpus_json(rows.coalesce(1), path)
    written = corpus_json.read_written_json(spark, path)
    assert written.count() == 400 and len(written.inputFiles()) > 2
