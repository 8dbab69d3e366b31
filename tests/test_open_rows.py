"""Open rows are the undecided review rows, although the constraint guard meets them last and settled rows leave early."""

import pytest
from pyspark.sql import functions as F

from twinproof.operators import overlay
from twinproof.plans import queries_flow, review, workload as L
from twinproof.profile import TRUST_FUND

SF = "/root/testdata/sf0.001"
COLUMNS = ["pair_id", "field", "label", "contract_raw", "im_raw", "contract_ref_raw", "im_ref_raw", "judge_allowed", "status",
           "final_status", "final_reason_code", "final_reason", "canonical_status", "canonical_reason_code"]


def _rows(df):
    return sorted(map(repr, df.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return L.extractions(spark, SF).filter("substr(pair_id, -1) < '5'")


def test_open_rows_are_the_undecided_review_rows(docs):
    whole = review.review_rows(docs, ["pair_id"], details=False).localCheckpoint()
    # The constraint guard rejects rows here whose texts differ, so its place in the chain matters.
    assert whole.filter("array_contains(guard_rejections, 'G3:percent_range')").count() > 0
    left = whole.filter("final_status = 'needs_review'")
    assert _rows(review.open_rows(docs, ["pair_id"])) == _rows(left)
    assert _rows(review.open_rows(docs, ["pair_id"], judged_only=True)) == _rows(left.filter("judge_allowed"))
    assert left.filter("NOT judge_allowed").count() > 0


def test_open_reviews_and_answers_are_those_of_the_whole_run(docs, tmp_path):
    keys = ["pair_id", "run_id"]
    run = review.operational_review(docs, keys, str(tmp_path / "whole"), queries_flow.rule_judge)
    waiting = review.settle_open(docs, keys, queries_flow.rule_judge, str(tmp_path / "open"))
    told = lambda df: {r.run_id: r.open_reviews for r in overlay.run_statuses(df).collect() if r.open_reviews}
    assert told(waiting) == told(run.fields) != {}
    answers = review.judge_answers(docs, keys, str(tmp_path / "asked"), queries_flow.rule_judge)
    names = [*keys, "field", "route", "request", "problem", "judged"]
    rows = lambda df: sorted(map(repr, df.select(*names).collect()))
    assert rows(answers) == rows(run.answers)


def test_parts_can_be_limited_to_fields():
    wanted = ("fund.maturity_date", "fund.name")
    parts = TRUST_FUND.parts(wanted)
    assert sorted(f for p in parts for f in p.fields) == sorted(wanted)
    assert all(p.whole == TRUST_FUND.fields for p in parts)
