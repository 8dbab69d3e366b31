import pytest
from pyspark.sql import functions as F

from twinproof.functions import canonical as C
from twinproof.functions import text as TX
from twinproof.operators import compare

PERCENT = [
    ("연 0.89%", "0.89", "percent_unit"), ("[운용] 연[ 0.89 ] %", "0.89", "percent_unit"),
    ("연 1,000분의 8.9", "0.89", "permille_unit"), ("연 1000분의 8.9", "0.89", "permille_unit"),
    ("연 1천분의 8.9", "0.89", "permille_unit"), ("연 1，000분의 8.9", "0.89", "permille_unit"),
    ("89bp", "0.89", "basis_point_unit"), ("12 Basis Points", "0.12", "basis_point_unit"),
    ("0.890　%", "0.890", "percent_unit"), ("1,000분의 [8.9]", None, "percent_unparseable"),
    ("연 1,000분의 0.0", "0", "permille_unit"), ("100bp", "1", "basis_point_unit"),
    ("0.0089", None, "percent_unit_missing"), ("없는 표현", None, "percent_unparseable"),
    ("5bp 또는 0.3%", "0.3", "percent_unit"), ("  ", None, "missing_raw_text"), (None, None, "missing_raw_text"),
]
DATE = [
    ("2025-07-22", "2025-07-22", "date_parsed"), ("2025.07.22", "2025-07-22", "date_parsed"),
    ("2025/7/2", "2025-07-02", "date_parsed"), ("2025 년 7 월 22 일부터", "2025-07-22", "date_parsed"),
    ("２０２５년 ７월 ２일", "2025-07-02", "date_parsed"), ("2025년 1월 1일, 2024.02.03", "2024-02-03", "date_parsed"),
    ("2025-02-30 및 2025년 3월 1일", None, "date_invalid"), ("0000-01-01", None, "date_invalid"),
    ("미정", None, "date_unparseable"),
]
DURATION = [("3년", "36", "duration_parsed"), ("1년 6개월", "18", "duration_parsed"), ("0개월", None, "duration_unparseable"),
            ("2027년", "24324", "duration_parsed"), ("즉시", None, "duration_unparseable"),
            ("99999999999999999999년", None, "duration_unparseable")]
BOOLEAN = [("환매 가능", "true", "boolean_true"), ("환매 불가", "false", "boolean_false"),
           ("환매할 수 없음", "false", "boolean_false"), ("환매가 허용되지 않는", "true", "boolean_true"),
           ("청구할 수 있다", "true", "boolean_true"), ("문의", None, "boolean_unparseable")]


@pytest.mark.parametrize("kind,rows", [("percent", PERCENT), ("date", DATE), ("duration", DURATION), ("boolean", BOOLEAN)])
def test_parsers(spark, kind, rows):
    df = spark.createDataFrame(rows, "raw string, value string, code string")
    out = C.parse(df, kind, "raw", "p").select("raw", "value", "code", F.col("p.value").alias("v"), F.col("p.reason_code").alias("c")).collect()
    assert [(r.raw, r.v, r.c) for r in out] == [(r.raw, r.value, r.code) for r in out]


def test_guard_dialects_differ(spark):
    rows = [("89bp", None, None), ("연 1천분의 8.9", None, None), ("[x] 연[ 8.9 ] %", 8.9, None), ("연 1,000분의 8.9", 0.89, None),
            ("2025.07.22", None, None), ("설정 2025-07-22", None, None), ("2025-07-22 예정", None, "2025-07-22"),
            ("2025-7-2 예정", None, None), ("2025/7/2", None, "2025-07-02"), ("2025-02-30 또는 2025년 3월 1일", None, "2025-03-01")]
    df = spark.createDataFrame(rows, "raw string, pct double, dt string").withColumns(
        {"p": C.guard_percent_probe(F.col("raw")), "d": C.guard_date_probe(F.col("raw"))})
    for r in df.select("raw", "pct", "dt", C.guard_percent_value(F.col("p")).alias("gp"), C.guard_date_value(F.col("d")).alias("gd")).collect():
        assert (r.gp, r.gd) == (r.pct, r.dt), r.raw


def test_maturity_needs_a_reference(spark):
    cells = "contract_raw string, im_raw string, contract_ref_raw string, im_ref_raw string, want string"
    rows = [("최초설정일로부터 3년", "2028-07-22", "2025년 7월 22일", "2025-07-22", "same_after_normalization"),
            ("3년", "2028-07-22", "2025년 7월 22일", None, "needs_review"),
            ("설정일로부터 3년", "2028-07-23", "2025년 7월 22일", None, "different_after_normalization"),
            ("설정일로부터 1개월", "2024-02-29", "2024-01-31", None, "same_after_normalization"),
            ("설정일로부터 3년", "2028-07-22", None, None, "needs_review")]
    df = spark.createDataFrame(rows, cells).withColumn("field", F.lit("fund.maturity_date"))
    for r in compare.cross_check_policy(df).select("want", "final_status").collect():
        assert r.final_status == r.want


def test_strict_text_versus_decimals(spark):
    df = spark.createDataFrame([("fee_schedule.trust_fee", "0.890%", "0.89%")], "field string, contract_raw string, im_raw string")
    status = lambda **kw: compare.cross_check_policy(df, **kw).first().final_status
    assert status() == "different_after_normalization"
    assert status(strict_text=False) == "same_after_normalization"


def test_text_helpers(spark):
    df = spark.createDataFrame([("```json\n{\"a\":1}\n```", "이지 ＯＮ 제１호", "㈜ Ⅳ호 제12호")], "f string, w string, s string")
    r = df.select(TX.strip_fence(F.col("f")).alias("a"), TX.alias_key(F.col("w")).alias("k"), TX.alias_key(F.col("s")).alias("slow"),
                  TX.series_numbers(F.col("s")).alias("n")).first()
    assert r.a == '{"a":1}' and r.k == "이지on제1호" and r.slow == "주iv호제12호" and r.n == ["12"]


@pytest.mark.parametrize("text,ok", [('{"a":1}', True), ('{"a":1}}', False), ('{"a":1}]', False), ('[1]', False), ('{"a":1},{"b":2}', False), ("", False), ("x", False)])
def test_json_objects(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(TX.is_json_object(F.col("t"))).first()[0] is ok
