"""Costly expressions stay out of places where Spark interprets them or runs them once an element."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from twinproof.functions import text as TX
from twinproof.operators import constraints as K, evidence, guards, normalize as N
from twinproof.plans import workload as L
from twinproof.plans.queries_flow import raw_documents, rule_normalizer
from twinproof.session import late_filter, unrolled

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_parsed_once_an_attempt(spark):
    """no parser inside a lambda, one parse for the signature and one for each schema."""
    held = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = _plan(guards.check_format(raw_documents(spark, SF), ["pair_id"]))
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", held)
    assert len(re.findall(r"from_json\(|jsontostructs\(", plan, re.I)) <= 4
    assert len(re.findall(r"parse_json\(|parseJson", plan)) <= 2


def test_answers_are_parsed_once(spark):
    """one parse for the checks and one for the typed sides."""
    rows = spark.createDataFrame([("D1", "fee_schedule.trust_fee", "1%", 1, "2%", 1, "percent_per_year")],
                                 "pair_id string, field string, contract_raw string, contract_page int, im_raw string, im_page int, target_unit string")
    held = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = _plan(N._answer_wave(rows, rule_normalizer, None))
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", held)
    assert len(re.findall(r"from_json\(|jsontostructs\(", plan, re.I)) <= 2


def test_problems_of_odd_documents(spark):
    rows = spark.createDataFrame([("[1]",), ('{"a": 1} x',), ('{"schema_version": "v0"}',), (None,), ("{",)], "t string")
    out = [r.violations for r in evidence.validate_extractions(rows, "t").collect()]
    assert out[0] == out[1] == out[3] == out[4] == ["json_invalid:$"]
    assert "missing_key:$.fund" in out[2]


def test_strip_takes_every_white_space(spark):
    odd = [(chr(c) + " a" + chr(c) + "b\n" + chr(c),) for c in range(1, 0x3100)] + [("",), (" 　\n",), (None,)]
    rows = spark.createDataFrame(odd, "t string")
    want = F.regexp_replace("t", rf"(?U)^{TX.WS}+|{TX.WS}+$", "")
    assert rows.filter(~TX.strip(F.col("t")).eqNullSafe(want)).count() == 0


def test_arrays_are_built_before_the_generator(spark):
    """A generator's own expression is interpreted row by row."""
    docs = L.extractions(spark, SF)
    long = evidence.flatten(docs, ["pair_id"])
    for df in (long, evidence.split_sides(long, ["pair_id"]), K.raw_triples(long, structure=True), K.extraction_triples(docs),
               late_filter(long, F.col("ord") > 3)):
        made = re.findall(r"Generate (\w+)\(([^#,]*)", _plan(df))
        assert made and all("(" not in inner for _, inner in made)


def test_unrolled_drops_empty_arrays_and_null_elements(spark):
    rows = spark.createDataFrame([(1, [1, None, 2]), (2, []), (3, None)], "k int, a array<int>")
    assert {tuple(r) for r in unrolled(rows, "e", F.col("a")).select("k", "e").collect()} == {(1, 1), (1, 2)}
