"""Normalization of nested extractions: the rows of the long form, from answers that are stored once."""

import datetime

from pyspark.sql import functions as F

from twinproof.operators import evidence, inference, normalize as N
from twinproof.plans import queries_flow as Q, queries_review as R, workload as L
from twinproof.profile import TRUST_FUND

SF = "/root/testdata/sf0.001"


def _lines(df):
    return sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).collect())


def test_extractions_give_the_rows_of_the_long_form(spark):
    """Also for refused answers and pairs without evidence."""
    docs = L.extractions(spark, SF).filter("substr(pair_id, -1) < '3'")
    for client in (Q.rule_normalizer, R.hashed_normalizer):
        whole = N.normalize(evidence.flatten(docs, ["pair_id"]), ["pair_id"], client)
        parts = N.normalize_extractions(docs, ["pair_id"], client)
        assert parts.columns == whole.columns and _lines(parts) == _lines(whole)
        assert parts.count() == len(TRUST_FUND.fields) * docs.count()


def test_a_wave_flattens_its_own_fields_only(spark, monkeypatch):
    """no wave builds the rows of all fields to drop most of them."""
    seen, flatten = [], N.flatten
    monkeypatch.setattr(N, "flatten", lambda df, keys, profile: (seen.append(profile.fields), flatten(df, keys, profile=profile))[1])
    N.normalize_extractions(L.extractions(spark, SF).limit(3), ["pair_id"], Q.rule_normalizer).collect()
    targets = set(TRUST_FUND.normalization_targets)
    assert [set(x) for x in seen] == [set(TRUST_FUND.fields), targets - {"fund.maturity_date"}, {"fund.maturity_date"}]


def test_columns_beside_the_request_pass_as_they_are(spark):
    """Python sees the texts only; nulls, dates and nested values come back unchanged."""
    rows = [(1, None, datetime.date(2020, 1, 2), ["a", None], "x"), (None, "t", None, None, "bad"), (3, "u", None, [], None)]
    asked = spark.createDataFrame(rows, "n int, t string, d date, l array<string>, request string").coalesce(1)

    def client():
        return lambda texts: [ValueError("no") if t == "bad" else {"text": None, "input_tokens": 2.0} if t is None else t.upper() for t in texts]

    out = inference.call_model(asked, client).drop("latency_ms").collect()
    assert [tuple(r) for r in out] == [
        (*rows[0], "X", None, None, None), (*rows[1], None, "no", None, None), (*rows[2], None, None, 2, None)]
