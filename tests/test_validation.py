"""Documents that read back to their own text need no signature; every other one is checked as before."""

import json

import pytest
from pyspark.sql import functions as F

from twinproof.operators import compare, evidence, guards
from twinproof.plans import review, workload as L
from twinproof.plans.queries_flow import raw_documents

SF = "/root/testdata/sf0.001"


def _text(spark, change=lambda d: None, **how):
    doc = json.loads(L.extractions(spark, SF).filter("pair_id = 'D1'").select(F.to_json("extraction", {"ignoreNullFields": "false"})).first()[0])
    change(doc)
    return json.dumps(doc, **({"ensure_ascii": False, "separators": (",", ":")} | how))


CHANGES = {
    "plain": (lambda d: None, []),
    "version": (lambda d: d.update(schema_version="v1"), ["bad_version"]),
    "no version": (lambda d: d.update(schema_version=None), ["bad_type"]),
    "section is null": (lambda d: d.update(fund=None), None),
    "cell is null": (lambda d: d["fund"]["name"].update(im=None), None),
    "no page": (lambda d: d["fund"]["name"]["contract"].update(raw_text="x", citation={"document": "IM", "page": None}), ["bad_type"]),
    "page 0": (lambda d: d["fund"]["name"]["contract"].update(raw_text="x", citation={"document": "IM", "page": 0}), ["bad_page"]),
    "other document": (lambda d: d["fund"]["name"]["contract"].update(raw_text="x", citation={"document": "other", "page": 1}), ["bad_document"]),
    "uncited": (lambda d: d["fund"]["name"]["contract"].update(raw_text="x", citation=None), ["raw_text_without_citation"]),
    "number as text": (lambda d: d["fund"]["name"]["contract"].update(raw_text=5), None),
    "unknown key": (lambda d: d.update(extra="1"), ["unknown_key"]),
}


@pytest.mark.parametrize("name", CHANGES)
def test_own_text_and_another_layout_are_judged_alike(spark, name):
    """the short way and the signature give the same problems and the same document."""
    change, kinds = CHANGES[name]
    texts = [_text(spark, change), _text(spark, change, separators=(", ", ": "), indent=1)]
    out = evidence.validate_extractions(spark.createDataFrame([(t,) for t in texts], "raw string"), "raw").collect()
    assert out[0].violations == out[1].violations and out[0].extraction == out[1].extraction
    assert (out[0].extraction is None) == bool(out[0].violations)
    assert kinds is None and out[0].violations or [v.split(":")[0] for v in out[0].violations] == kinds


def test_documents_of_our_own_form_are_not_parsed_to_variants(spark):
    raw = raw_documents(spark, SF).select("pair_id", "raw")
    plan = evidence.validate_extractions(raw, "raw")._jdf.queryExecution().analyzed().toString()
    assert "_own" in plan
    twice = spark.createDataFrame([(_text(spark)[:-1] + ',"schema_version":"v0"}',), (_text(spark) + " {}",)], "raw string")
    assert all(r.extraction is None and r.violations for r in evidence.validate_extractions(twice, "raw").collect())


def test_checks_by_part_equal_the_checks_in_one_piece(spark):
    """values of the policy and the whole chain of events."""
    docs = L.extractions(spark, SF).filter("substr(pair_id, -1) < '2'")
    keys = ["pair_id", "contract_pages", "im_pages"]
    lines = lambda df: sorted(map(repr, df.collect()))
    told = ["pair_id", "field", "final_status", "canonical"]
    parts = evidence.flatten_parts(docs, keys, lambda r, p: compare.cross_check_policy(guards.apply_guards(r, profile=p, with_events=False), p))
    assert lines(parts.select(told)) == lines(compare.cross_check_policy(guards.apply_guards(evidence.flatten(docs, keys))).select(told))
    options, shaped = guards.GuardOptions(use_shapes=True), guards.with_shape_event(docs)
    parts = evidence.flatten_parts(shaped, [*keys, "shape_event"], lambda r, p: guards.apply_guards(r, options, p))
    whole = guards.apply_guards(evidence.flatten(shaped, [*keys, "shape_event"]), options)
    assert lines(guards.explode_events(parts, ["pair_id"])) == lines(guards.explode_events(whole, ["pair_id"]))


def test_modes_meet_guards_in_guard_mode_only(spark):
    """rows of the free modes carry no events; each pair has its rows in every mode."""
    docs = raw_documents(spark, SF, "extraction", "contract_pages", "im_pages").filter("substr(pair_id, -1) = '1'")
    rows = review.run_modes(docs, ["pair_id"]).collect()
    n, refused = docs.count(), sum(r.g1_fatal for r in rows)
    assert {m: sum(r.mode == m for r in rows) for m in review.MODES} == {"baseline": 14 * n, "ontology": 14 * n, "guard": 14 * (n - refused) + refused}
    assert all(not r.guard_events and not r.guard_caught for r in rows if r.mode != "guard") and refused
    assert all(r.final_status is None and r.conforms is None for r in rows if r.mode == "baseline" or r.g1_fatal)
