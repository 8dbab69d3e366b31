"""Small operators that queries use only in part."""

import json

from pyspark.sql import functions as F

from own_cases import own_cases
from twinproof.operators import evidence, guards, inference, mutate
from twinproof.streaming import intake


def test_reference_cells_join_only_the_derived_field(spark):
    rows = [("p1", "fund.inception_date", "2031-01-02", 3), ("p1", "fund.maturity_date", "2년", 4), ("p2", "fund.maturity_date", "3년", 5)]
    long = spark.createDataFrame(rows, "pair_id string, field string, contract_raw string, contract_page int").withColumns({
        "contract_doc": F.lit("d"), "im_raw": F.lit(None).cast("string"), "im_page": F.lit(None).cast("int"), "im_doc": F.lit(None).cast("string")})
    got = {(r.pair_id, r.field): (r.contract_ref_raw, r.contract_ref_page) for r in evidence.attach_reference(long, ["pair_id"]).collect()}
    assert got == {("p1", "fund.inception_date"): (None, None), ("p1", "fund.maturity_date"): ("2031-01-02", 3), ("p2", "fund.maturity_date"): (None, None)}


def test_pages_roles_and_report_order(spark):
    pairs = spark.createDataFrame([("p1",), ("p2",)], "pair_id string")
    docs = spark.createDataFrame([("p1", "contract", 7), ("p1", "im", 9)], "pair_id string, side string, pages long")
    assert {r.pair_id: (r.contract_pages, r.im_pages) for r in guards.attach_pages(pairs, docs).collect()} == {"p1": (7, 9), "p2": (None, None)}
    roles = spark.createDataFrame([("IM",), ("x",), ("신탁계약서",)], "role string").orderBy(evidence.role_order(F.col("role")))
    assert [r.role for r in roles.collect()] == ["신탁계약서", "IM", "x"]
    ids = [r.case_id for r in mutate.ordered_cases(own_cases(spark)).collect()]
    assert ids == [f"case-{i}" for i in range(24)]


def test_baseline_requests_name_absent_texts(spark):
    cases = own_cases(spark).withColumn("label", F.lit("l")).filter("case_id in ('case-0', 'case-23')")
    got = {r.case_id: json.loads(r.request) for r in inference.baseline_requests(cases).collect()}
    assert got["case-0"]["contract"] == "연 1,000분의 2.5" and got["case-23"]["contract"] == "(없음)"


def test_stream_drops_exact_repeats(spark, tmp_path):
    rows = [("k", i // 2) for i in range(6)]
    spark.createDataFrame(rows, "id string, n long").withColumn("at", F.timestamp_seconds(F.lit(1_000))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, n long, at timestamp").parquet(str(tmp_path / "in"))
    query = intake.drop_repeats(stream, "at", "1 minute", "id", "n").writeStream.format("memory").queryName("seen").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen").count() == 3
