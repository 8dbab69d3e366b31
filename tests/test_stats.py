import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinproof.functions import distributions as D
from twinproof.operators import stats

# The published F2 of thirty repeated runs of the two tiers, in order of the runs.
TIER2 = [0.9009, 0.9009, 0.905, 0.9009, 0.9009, 0.8969, 0.8969, 0.8784, 0.8824, 0.8969, 0.9009, 0.9009, 0.8969, 0.8969, 0.9009,
         0.8969, 0.8969, 0.9009, 0.9009, 0.9009, 0.9009, 0.8824, 0.8824, 0.8784, 0.9009, 0.9009, 0.8824, 0.9009, 0.9009, 0.9009]
TIER3 = [0.885, 0.8889, 0.8889, 0.8889, 0.8889, 0.8889, 0.8889, 0.8889, 0.8889, 0.8889, 0.8889, 0.885, 0.8889, 0.8889, 0.8889,
         0.8889, 0.885, 0.8889, 0.8929, 0.8705, 0.885, 0.8889, 0.8889, 0.8929, 0.8889, 0.8889, 0.8889, 0.8744, 0.8929, 0.8889]


def reps(spark):
    rows = [("t1", 0.6098)] * 30 + [("t2", v) for v in TIER2] + [("t3", v) for v in TIER3]
    return spark.createDataFrame([(t, "f2", v) for t, v in rows], "tier string, metric string, value double")


def test_significance_matches_reported_values(spark):
    assert len(TIER2) == len(TIER3) == 30
    out = {r.comparison: r for r in stats.significance_table(reps(spark), "t1", "t2", "t3", ["f2"]).collect()}
    w = out["t3 vs t2"]
    assert round(w.t_stat, 4) == -5.0447 and round(w.cohens_d, 4) == -1.3025 and round(w.mean_diff, 4) == -0.0085
    assert w.p_value == pytest.approx(7.401807664167573e-06, rel=1e-6)
    assert w.mannwhitney_p == pytest.approx(1.6957156687584227e-05, rel=1e-6)
    assert out["t2 vs t1"].t_stat == pytest.approx(197.449, abs=5e-3) and out["t2 vs t1"].p_value == pytest.approx(6.295678626663656e-47, rel=1e-3)
    assert out["t3 vs t1"].t_stat == pytest.approx(330.9835, abs=5e-3)


def test_descriptives(spark):
    rows = {r.tier: r for r in stats.describe(reps(spark), "tier").collect()}
    assert (round(rows["t2"].mean, 4), round(rows["t2"].sd, 4)) == (0.8961, 0.0079)
    assert (round(rows["t2"].ci_lo, 4), round(rows["t2"].ci_hi, 4)) == (0.8932, 0.8991)
    assert rows["t2"].median == float(np.median(TIER2)) and rows["t3"].median == float(np.median(TIER3))
    assert rows["t1"].ci_lo == rows["t1"].mean == rows["t1"].ci_hi and rows["t1"].sd == 0


def test_degenerate_samples(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 1.0), ("b", "m", 2.0), ("b", "m", 2.0)], "tier string, metric string, value double")
    r = stats.two_sample(stats.moments(df, "tier", "metric"), "a", "b", ["metric"]).first()
    assert r.test == "degenerate" and r.t_stat is None and r.p_value is None and math.isnan(r.cohens_d)


@pytest.mark.parametrize("b,c,p,method", [(0, 0, 1.0, "no_discordant"), (0, 4, 0.125, "exact_binomial"), (13, 4, 0.049041748046875, "exact_binomial"),
                                          (3, 3, 1.0, "exact_binomial"), (30, 10, math.erfc(math.sqrt(19**2 / 40 / 2)), "chi2_continuity")])
def test_mcnemar(spark, b, c, p, method):
    r = stats.mcnemar(spark.createDataFrame([(b, c, b + c)], "b bigint, c bigint, n bigint")).first()
    assert r.method == method and r.p_value == pytest.approx(p, rel=1e-4)


def test_exact_tail_for_large_counts(spark):
    counts = spark.createDataFrame([(480, 520, 1000), (900, 1100, 2000)], "b bigint, c bigint, n bigint")
    for r in stats.mcnemar(counts, exact=True).collect():
        k, n = min(r.b, r.c), r.n
        brute = sum(math.comb(n, i) for i in range(k + 1)) * 2 / 2**n
        assert r.p_value == pytest.approx(brute, rel=1e-6)


def test_bootstrap_agrees_with_resampling_rows(spark):
    rng = np.random.default_rng(7)
    gold = rng.random(400) < 0.5
    pred = np.where(rng.random(400) < 0.8, gold, ~gold)
    df = spark.createDataFrame([(bool(g), bool(p)) for g, p in zip(gold, pred)], "gold boolean, pred boolean")
    first = stats.bootstrap_f1(df).first()
    again = stats.bootstrap_f1(df.repartition(5)).first()
    assert (first.lo, first.hi) == (again.lo, again.hi)

    def f1(g, p):
        tp, fp, fn = (g & p).sum(), (~g & p).sum(), (g & ~p).sum()
        return 2 * tp / (2 * tp + fp + fn)

    brute = [f1(gold[i], pred[i]) for i in (rng.integers(0, 400, 400) for _ in range(2000))]
    assert first.point == pytest.approx(f1(gold, pred))
    assert first.lo == pytest.approx(np.quantile(brute, 0.025), abs=0.012)
    assert first.hi == pytest.approx(np.quantile(brute, 0.975), abs=0.012)
    assert first.lo <= first.point <= first.hi


def test_midranks_with_a_hot_value(spark):
    values = [1.0] * 500 + list(np.random.default_rng(1).normal(0, 1, 500).round(2))
    df = spark.createDataFrame([(v,) for v in map(float, values)], "value double").withColumn("g", F.lit("x"))
    counts = df.groupBy("g", "value").agg(F.count(F.lit(1)).alias("n"))
    got = {r.value: r["rank"] for r in stats.midranks(counts, ["g"], n_buckets=8).collect()}
    ordered = sorted(values)
    for v in set(values):
        lo = ordered.index(v) + 1
        assert got[v] == lo + (ordered.count(v) - 1) / 2


def test_last_duplicate_wins_and_majority(spark):
    cases = spark.createDataFrame([("c1", "a", 1, False), ("c1", "a", 2, True), ("c1", "b", 1, False), ("c2", "a", 1, True)],
                                  "case_id string, mode string, pos int, correct boolean")
    aligned = stats.align_modes(cases, ["a", "b"], "correct", order="pos").collect()
    assert [(r.case_id, r.mode_a, r.mode_b) for r in aligned] == [("c1", True, False)]
    assert [r.case_id for r in stats.skipped_cases(cases, ["a", "b"]).collect()] == ["c2"]
    runs = spark.createDataFrame([("k", None), ("k", None), ("k", "x"), ("j", "y"), ("j", "x")], "k string, v string")
    got = {r.k: (r.majority_value, r.n_agree) for r in stats.majority(runs, ["k"], "v").collect()}
    assert got == {"k": (None, 2), "j": ("x", 1)}


def test_beta_tail_reference_points():
    assert D.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074039, rel=1e-10)
    assert D.t_quantile(0.05, 29) == pytest.approx(2.045229642, rel=1e-8)
