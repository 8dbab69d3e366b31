import pytest
from pyspark.sql import functions as F

from own_cases import own_cases
from twinproof.operators import scoring
from twinproof.plans import modes

PAGES = (22, 32)


def _confusion(df):
    row = scoring.confusion_cells(scoring.classify(df)).first()
    return {k: row[k] for k in ("tp", "fp", "fn", "tn", "review", "missing", "predicted_review")}


def test_policy_mode_gives_the_derived_confusion(spark):
    out = modes.evaluate(own_cases(spark), "ontology_policy", *PAGES)
    assert _confusion(out) == {"tp": 6, "fp": 0, "fn": 2, "tn": 12, "review": 2, "missing": 2, "predicted_review": 4}
    m = scoring.score(scoring.classify(out)).first()
    assert m["recall"] == pytest.approx(6 / 8)
    assert m["f1"] == pytest.approx(2 * 0.75 / 1.75)
    assert m["f2"] == pytest.approx(5 * 0.75 / (4 + 0.75))
    assert m["accuracy"] == pytest.approx(18 / 22)
    assert m["review_rate"] == pytest.approx(4 / 24)


def test_reported_ratios_follow_from_the_reported_confusion(spark):
    """The published counts (fixed values) give the published ratios."""
    cells = {"tp": 25, "fp": 0, "fn": 20, "tn": 15, "review": 16}
    p, r = 1.0, cells["tp"] / (cells["tp"] + cells["fn"])
    kinds = [("mismatch", "mismatch", 25), ("mismatch", "match", 20), ("match", "match", 15), ("match", "review", 16), ("missing", "missing", 4)]
    rows = [(f"c{i}-{k}", g, f, "x") for i, (g, f, n) in enumerate(kinds) for k in range(n)]
    df = spark.createDataFrame(rows, "case_id string, gold_label string, predicted_label string, field string").withColumns({
        "guard_caught": F.lit(False), "guard_rejections": F.array().cast("array<string>"), "final_reason_code": F.lit("x"),
        "mutation_type": F.lit("x"), "difficulty": F.lit("x"), "harness_signal": F.lit("x")})
    m = scoring.score(scoring.classify(df)).first()
    assert round(m["f2"], 4) == 0.6098 == round(5 * p * r / (4 * p + r), 4)
    assert round(m["recall"], 4) == 0.5556 and round(m["f1"], 4) == 0.7143 and round(m["accuracy"], 4) == 0.5263


def test_decimal_equality_gives_the_same_confusion(spark):
    out = modes.evaluate(own_cases(spark), "ontology_policy", *PAGES, strict_text=False)
    assert _confusion(out)["tp"] == 6


def test_guard_rejects_only_in_guarded_modes(spark):
    fake = own_cases(spark, citations=True)
    on = modes.evaluate(fake, "guard", *PAGES)
    assert {tuple(r.guard_rejections) for r in on.collect()} == {("G2:page_out_of_range",)}
    off = modes.evaluate(fake, "ontology", *PAGES)
    assert off.filter("guard_caught").count() == 0
    assert modes.evaluate(own_cases(spark), "guard", *PAGES).filter("guard_caught").count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        modes.evaluate(own_cases(spark), "baseline", *PAGES)


def test_breakdowns_match_direct_groupings(spark):
    scored = scoring.classify(modes.evaluate(own_cases(spark), "ontology_policy", *PAGES)).cache()
    blocks = scoring.breakdowns(scored)
    assert blocks.count() == 1 + sum(scored.select(d).distinct().count() for d in scoring.DIMENSIONS)
    for d in scoring.DIMENSIONS:
        direct = {r[d]: (r.n, r.tp, round(r.recall, 9)) for r in scoring.score(scored, d).collect()}
        rolled = {r.level: (r.n, r.tp, round(r.recall, 9)) for r in blocks.filter(F.col("block") == d).collect()}
        assert direct == rolled


def test_no_shuffle_before_scoring(spark):
    plan = modes.evaluate(own_cases(spark), "ontology_policy", *PAGES)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "Exchange hashpartitioning" not in physical and "SortMergeJoin" not in physical


def test_whole_texts_beyond_a_million_characters(spark):
    from twinproof.functions import canonical
    from twinproof.operators.mutate import replace_third

    long = "가" * 1_200_000 + "끝"
    df = spark.createDataFrame([(long,)], "t string").select(replace_third(F.col("t")).alias("r"), canonical._rest(F.col("t")).alias("v")).first()
    assert len(df.r) == len(long) and df.r.endswith("끝") and len(df.v) == len(long) - 2
