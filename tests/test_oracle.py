"""A cross-section of registered queries against their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ("parse_percent", "mode_policy", "breakdown_sets", "guard_events", "policy_cross_check", "shape_violations",
         "mcnemar", "mann_whitney", "rep_descriptives", "alias_match", "decision_overlay", "judge_verdicts",
         "normalization_run", "schema_violations", "case_csv_round_trip", "review_stream", "decision_stream",
         "operational_review", "harness_modes", "review_stream_aliases", "judge_refusals", "normalization_requests", "resumed_reps")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, message, n = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok and n > 0, message


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["field", "n", "n_correct", "tp", "fp", "fn", "tn", "review", "missing", "recall"]
