from pyspark.sql import functions as F

from twinproof.operators import constraints as K
from twinproof.operators import evidence, guards, inference, normalize, overlay, scoring
from twinproof.plans import workload as L
from twinproof.plans.queries_flow import rule_normalizer
from twinproof.session import late_filter

SF = "/root/testdata/sf0.001"
TRIPLE = "graph_id string, s string, p string, o string, o_kind string, o_datatype string"


def _graph(**changes):
    base = {("fund_contract", "fund_name"): ["F"], ("party_contract", "asset_manager"): ["A"], ("party_contract", "trustee"): ["T"],
            ("fee_schedule_contract", "management_fee"): ["0.5 %"], ("fund_im", "fund_name"): ["F"], ("party_im", "asset_manager"): ["A"],
            ("fee_schedule_im", "management_fee"): ["0.5 %"]}
    for key, values in changes.items():
        base[tuple(key.split("__"))] = values
    return [("g", s, p, v, "literal", None) for (s, p), values in base.items() for v in values]


def test_shapes(spark):
    structure = K.structure_triples(spark.createDataFrame([("g",)], "pair_id string"))
    wants = [
        ({}, set()), ({"fee_schedule_contract__management_fee": []}, {"management_fee_min"}),
        ({"party_contract__trustee": []}, {"contract_trustee_exactly_one"}),
        ({"party_contract__trustee": ["T", "U"]}, {"contract_trustee_exactly_one"}),
        ({"fee_schedule_im__management_fee": ["연 8.9 %"]}, {"management_fee_range"}),
        ({"fee_schedule_im__management_fee": ["1,000분의 60"]}, {"management_fee_range"}),
        ({"fund_im__inception_date": ["2025년 7월 22일"], "fund_im__maturity_date": ["2025년 7월 21일"]}, {"maturity_order"}),
        ({"fund_im__inception_date": ["2025-07-22"], "fund_im__maturity_date": ["2025-07-21"]}, set()),
    ]
    for changes, want in wants:
        triples = structure.unionByName(spark.createDataFrame(_graph(**changes), TRIPLE))
        got = {r["constraint"] for r in K.shape_violations(triples).collect()}
        assert got == want, changes
        assert K.conformance(triples).first().conforms == (not want)


def test_rejected_cell_hides_from_the_next_guard(spark):
    rows = [("fee_schedule.trust_fee", "연 3.5%", 999, "신탁계약서", "0.1%", 1, "신탁계약서")]
    df = spark.createDataFrame(rows, "field string, contract_raw string, contract_page int, contract_doc string, im_raw string, im_page int, im_doc string")
    r = guards.apply_guards(guards.with_pages(df, 22, 32)).first()
    assert r.guard_rejections == ["G2:page_out_of_range", "G2:citation_document_mismatch"]
    assert r.contract_raw is None and r.contract_page is None and r.im_raw is None
    assert {e.guard for e in r.guard_events} == {"G2"}


def test_strict_validation_details(spark):
    good = L.extractions(spark, SF).select(F.to_json("extraction", {"ignoreNullFields": "false"}).alias("j")).first().j
    cases = [(good, []), (good.replace('"page":', '"page":-', 1), ["bad_page"]),
             (good.replace('"document":"신탁계약서"', '"document":"other"', 1), ["bad_document"]), ("{}", ["missing_key"] * 5)]
    out = evidence.validate_extractions(spark.createDataFrame([(c[0],) for c in cases], "raw_json string")).collect()
    for (_, want), row in zip(cases, out):
        assert sorted(v.split(":")[0] for v in row.violations) == want
        assert (row.extraction is None) == bool(want)


def test_alias_rules(spark):
    rows = [("R1", "fund.name", "same", "마루 제1호", "MARU 1호", "1"), ("R1", "fund.name", "same", "마루 제1호", "마루 제2호", "2"),
            ("R1", "party.trustee", "different", "a", "b", "3"), ("R1", "fund.type", "same", "a", "b", "4"),
            ("R1", "party.trustee", "same", "ＡＢ", "a b", "5")]
    df = spark.createDataFrame(rows, "run_id string, field string, decision string, contract_raw string, im_raw string, decided_at string")
    got = {r.decided_at: r.alias_outcome for r in overlay.alias_requests(df).collect()}
    assert got == {"1": "accepted", "2": "refused_series_conflict", "3": "refused_not_same", "4": "refused_field", "5": "no_change"}


def test_human_decision_keeps_system_status(spark):
    fields = spark.createDataFrame([("R", "f", "needs_review", "needs_human_review", "unresolved", True)],
                                   "run_id string, field string, system_status string, effective_status string, resolution_source string, requires_human_review boolean")
    for decision, status, open_ in (("same", "match", False), ("different", "mismatch", False), ("unknown", "needs_human_review", True)):
        d = spark.createDataFrame([("R", "f", decision)], "run_id string, field string, decision string")
        r = overlay.apply_decisions(fields, d).first()
        assert (r.system_status, r.effective_status, r.resolution_source, r.requires_human_review) == ("needs_review", status, "human", open_)


def test_failed_model_calls_stay_in_review(spark):
    df = spark.createDataFrame([("p", "fund.name", "generic", "{}")], "pair_id string, field string, route string, request string")

    def broken():
        def call(texts):
            raise RuntimeError("down")
        return call

    r = inference.read_verdicts(inference.call_model(df, broken)).first()
    assert r.problem == "call_failed" and r.judged is None and "down" in r.error


def test_normalization_sides(spark):
    rows = [("p", "fee_schedule.trust_fee", "연 0.89%", "0.8900001%"), ("p", "fund.inception_date", "2025-07-22", None), ("p", "fund.name", "a", "b")]
    df = spark.createDataFrame(rows, "pair_id string, field string, contract_raw string, im_raw string")
    df = df.withColumns({f"{s}_page": F.when(F.col(f"{s}_raw").isNotNull(), F.lit(1)) for s in ("contract", "im")})
    out = {r.field: r for r in normalize.normalize(df, ["pair_id"], rule_normalizer).collect()}
    assert out["fee_schedule.trust_fee"].normalization_status == "same_after_normalization"
    assert out["fund.inception_date"].normalization_status == "partially_normalized"
    assert out["fund.inception_date"].im.reason_code == "missing_evidence"
    assert out["fund.name"].reason_code == "field_not_in_scope"


def test_scored_metrics(spark):
    rows = [("match", "match")] + [("mismatch", "mismatch")] * 2 + [("mismatch", "match"), ("mismatch", "review"), ("match", "review"), ("missing", "missing"), ("missing", "match")]
    df = spark.createDataFrame(rows, "gold_label string, predicted_label string")
    r = scoring.score(scoring.classify(df)).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.review, r.missing) == (2, 0, 2, 1, 1, 2)
    assert (r.precision, r.recall, round(r.f1, 4), r.accuracy, r.review_rate, r.hallucination_rate) == (1.0, 0.5, 0.6667, 0.5, 0.25, 0.5)


def test_late_filter_keeps_exactly_the_matching_rows(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") > 4))
    assert sorted(r.id for r in late_filter(df, F.col("x")).collect()) == [5, 7, 8]
