"""Rows checked part by part of a profile are the rows checked in one piece; counts need no events."""

from pyspark.sql import functions as F

from twinproof.operators import compare, evidence, guards
from twinproof.plans import review, workload as L
from twinproof.profile import TRUST_FUND
from twinproof.session import get_spark

SF = "/root/testdata/sf0.001"
KEYS = ["pair_id", "contract_pages", "im_pages"]


def _lines(df, columns):
    return sorted(df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0])


def test_parts_cover_the_profile_in_its_order():
    parts = TRUST_FUND.parts()
    assert sorted(f for p in parts for f in p.fields) == sorted(TRUST_FUND.fields)
    assert all(p.order == {f: i for i, f in enumerate(TRUST_FUND.fields)} for p in parts)


def test_review_rows_by_part_equal_rows_in_one_piece():
    docs = L.extractions(get_spark(), SF).filter("substr(pair_id, -1) < '4'")
    options = guards.GuardOptions(use_shapes=True)
    shaped = guards.with_shape_event(docs, options=options)
    whole = compare.cross_check_policy(guards.apply_guards(evidence.flatten(shaped, [*KEYS, "shape_event"]), options))
    parts = review.review_rows(docs, ["pair_id"], options=options)
    assert set(parts.columns) == set(whole.columns)
    columns = sorted(whole.columns)
    assert _lines(parts, columns) == _lines(whole, columns)
    slim = review.review_rows(docs, ["pair_id"], details=False)
    assert not {"guard_events", "canonical"} & set(slim.columns)
    kept = [c for c in columns if c in slim.columns]
    assert _lines(slim, kept) == _lines(whole, kept)


def test_counts_and_rejections_come_from_rows_not_events():
    docs = L.extractions(get_spark(), SF).filter("substr(pair_id, -1) < '4'")
    docs = docs.unionByName(docs.limit(20))  # repeated keys
    whole = guards.apply_guards(evidence.flatten(docs, KEYS))
    events = guards.explode_events(whole, ["pair_id"])
    rows = evidence.flatten_parts(docs, KEYS, lambda r, p: guards.apply_guards(r, profile=p, with_events=False, count_events=True))
    assert "guard_events" not in rows.columns
    told = guards.rejected_fields(rows, ["pair_id"])
    assert _lines(told, ["pair_id", "field", "guard_rejections"]) == _lines(
        guards.rejections_by_field(events, ["pair_id"]), ["pair_id", "field", "guard_rejections"])
    counts = {(r.pair_id, r.field): r.n_events for r in guards.count_by_field(rows, ["pair_id"]).collect()}
    paired = whole.select("pair_id", "field").join(
        events.select("pair_id", guards.parent_field(F.col("field_path")).alias("field"), F.lit(1).alias("e")), ["pair_id", "field"], "left")
    wanted = {(r.pair_id, r.field): r.n for r in paired.groupBy("pair_id", "field").agg(F.count("e").alias("n")).collect()}
    assert counts == wanted
