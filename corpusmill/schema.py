"""Data contracts: the shapes and fixed values every module shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Texts that must be equal in every produced document.
MISSING = "정보 없음"
NO_ANSWER = "모르겠습니다"
ANSWER_MARKER = "##[USER_ANSWER]:"

# Cell texts a product sheet uses for "no value".
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

STRING_MAP = T.MapType(T.StringType(), T.StringType())

DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("bank", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("key_summary", T.StringType()),
    T.StructField("metadata", STRING_MAP),
])

DOCUMENT_FILE = T.StructType([T.StructField("documents", T.ArrayType(DOCUMENT))])

CATEGORY_SHEET = T.StructType([
    T.StructField("카테고리", T.StringType()),
    T.StructField("세부 항목", T.StringType()),
    T.StructField("내용", T.StringType()),
])

CORPUS = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", STRING_MAP),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

CHANGES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", STRING_MAP),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("query_vec", T.ArrayType(T.FloatType())),
])


@dataclass(frozen=True)
class SheetSpec:
    """What differs between two kinds of product sheet; everything else is shared code."""

    doc_type: str
    id_prefix: str
    key_fields: tuple[str, ...]
    bank_field: str = "은행"
    product_field: str | None = "상품명"
    clean_cells: bool = False


# The three sheet kinds with their type literal, id prefix and key fields.
DEMAND_DEPOSIT = SheetSpec(
    doc_type="입출금자유예금",
    id_prefix="입출금자유예금_product",
    key_fields=("은행", "상품명", "기본금리( %)", "최고금리(우대금리포함,  %)"),
)
TIME_DEPOSIT = SheetSpec(
    doc_type="정기예금",
    id_prefix="정기예금_product",
    key_fields=(
        "은행", "상품명", "기본금리(단리이자 %)", "최고금리(우대금리포함, 단리이자 %)",
        "전월취급평균금리(만기 12개월 기준)",
    ),
)
SOLDIER_SAVINGS = SheetSpec(
    doc_type="장병내일준비적금",
    id_prefix="military_product",
    key_fields=("은행", "제공 금리(%) 1개월 이상 ~ 3개월 미만", "1년 6개월 이상 ~ 만기", "우대금리 조건"),
    product_field=None,
    clean_cells=True,
)
SOLDIER_SAVINGS_GUIDE = SheetSpec(
    doc_type="장병내일준비적금 상품설명",
    id_prefix="military_desc",
    key_fields=(),
)
