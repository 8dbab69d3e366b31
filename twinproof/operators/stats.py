"""Paired and repeated-run statistics. Heavy parts are aggregations; tails run on result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinproof.functions import distributions as D
from twinproof.operators.scoring import ratio


# --- paired comparison ----------------------------------------------------------------------------


def last_per_case(df: DataFrame, keys: list[str], order: str, *payload: str) -> DataFrame:
    """Duplicate keys: the last one (by ``order``) wins. Reduces map-side."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(order)).alias("_p")).select(*keys, "_p.*")


def align_modes(cases: DataFrame, modes: list[str], value: str, order: str | None = None) -> DataFrame:
    """One row per case that every mode covers, with ``mode_<m>`` columns.

    ``cases(case_id, mode, value)`` is folded in one shuffle instead of N joins; the last
    duplicate (by ``order``) wins.
    """
    wide = _fold_modes(cases, modes, value, order)
    return wide.filter(F.col("_seen") == len(modes)).drop("_seen")


def skipped_cases(cases: DataFrame, modes: list[str]) -> DataFrame:
    """Cases of the first mode that some other mode lacks."""
    present = cases.groupBy("case_id").agg(
        *[F.max(F.col("mode") == m).alias(f"_in_{i}") for i, m in enumerate(modes)])
    everywhere = _all([F.col(f"_in_{i}") for i in range(len(modes))])
    return present.filter(F.col("_in_0") & ~everywhere).select("case_id")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _fold_modes(cases: DataFrame, modes: list[str], value: str, order: str | None) -> DataFrame:
    picks = []
    for m in modes:
        here = F.col("mode") == m
        v = F.when(here, F.col(value))
        picks.append((F.max_by(v, F.when(here, F.col(order))) if order else F.max(v)).alias(f"mode_{m}"))
    seen = [F.max(F.when(F.col("mode") == m, 1).otherwise(0)) for m in modes]
    total = seen[0]
    for s in seen[1:]:
        total = total + s
    return cases.filter(F.col("mode").isin(*modes)).groupBy("case_id").agg(*picks, total.alias("_seen"))


def discordance(aligned: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """b: a right and b wrong; c: the reverse; n = b + c."""
    x, y = F.col(f"mode_{a}"), F.col(f"mode_{b}")
    counts = aligned.groupBy(*keys).agg(F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"))
    return counts.withColumn("n", F.col("b") + F.col("c"))


def mcnemar(counts: DataFrame, exact: bool | None = None) -> DataFrame:
    """Statistic, p and method from discordant counts (exact below 25 unless forced)."""
    b, c, n = F.col("b"), F.col("c"), F.col("n")
    use_exact = (n < 25) if exact is None else F.lit(exact)
    gap = F.abs(b - c) - 1
    chi = (gap * gap) / n
    method = F.when(n == 0, F.lit("no_discordant")).when(use_exact, F.lit("exact_binomial")).otherwise(
        F.lit("chi2_continuity"))
    out = counts.withColumns({
        "method": method,
        "statistic": F.when(n == 0, F.lit(0.0)).when(use_exact, F.least(b, c).cast("double")).otherwise(chi),
    })
    by_beta = D.exact_binomial_p(F.when(F.col("method") == "exact_binomial", b.cast("double")), c.cast("double"))
    by_chi = D.chi2_1df_p(F.when(F.col("method") == "chi2_continuity", F.col("statistic")))
    return out.withColumn("p_value", F.when(n == 0, F.lit(1.0)).otherwise(F.coalesce(by_beta, by_chi)))


def mismatch_flags(scored: DataFrame, *keys: str) -> DataFrame:
    """(gold, predicted) as mismatch flags, gold=missing left out."""
    return scored.filter(F.col("gold_label") != "missing").select(
        *keys, (F.col("gold_label") == "mismatch").alias("gold"),
        (F.col("predicted_label") == "mismatch").alias("pred"))


def f1_cells(flags: DataFrame, *keys: str) -> DataFrame:
    g, p = F.col("gold"), F.col("pred")
    return flags.groupBy(*keys).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"),
        F.count_if(~g & ~p).alias("tn"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def bootstrap_f1(flags: DataFrame, *keys: str, n_boot: int = 2000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of F1 under resampling of cases.

    F1 depends on a resample only through its four cell counts, and those follow a
    multinomial law, so rows are reduced to four counts once and each replicate draws one
    multinomial. Work is rows + replicates, not their product. Draws are seeded by
    (seed, replicate): partitioning, retries and row order cannot change them.
    """
    if not 0 < ci < 1 or n_boot < 1:
        raise ValueError("ci must be inside (0, 1) and n_boot positive")
    cells = f1_cells(flags, *keys).filter(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") > 0)
    point = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    replicates = cells.withColumns({
        "point": point, "n": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"),
        "rep": F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))),
    })

    def draw(batches):
        import numpy as np

        for batch in batches:
            f1 = []
            for rep, tp, fp, fn, tn in zip(batch["rep"], batch["tp"], batch["fp"], batch["fn"], batch["tn"]):
                total = tp + fp + fn + tn
                a, b, c, _ = np.random.default_rng([seed, int(rep)]).multinomial(
                    total, [tp / total, fp / total, fn / total, tn / total])
                f1.append(2 * a / (2 * a + b + c) if a else 0.0)
            yield batch.assign(f1=f1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in replicates.schema) + ", f1 double"
    drawn = replicates.mapInPandas(draw, schema)
    alpha = (1.0 - ci) / 2.0
    bounds = F.percentile("f1", F.array(F.lit(alpha), F.lit(1.0 - alpha)))
    out = drawn.groupBy(*keys, "tp", "fp", "fn", "tn", "n", "point").agg(bounds.alias("_b"))
    return out.select(*keys, "n", "tp", "fp", "fn", "tn", "point", F.col("_b")[0].alias("lo"),
                      F.col("_b")[1].alias("hi"), F.lit(n_boot).alias("n_boot"), F.lit(ci).alias("ci"))


# --- repeated runs ----------------------------------------------------------------------------------


def moments(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    x = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var"),
        F.min(x).alias("min"), F.max(x).alias("max"))


def describe(df: DataFrame, *keys: str, value: str = "value", ci: float = 0.95) -> DataFrame:
    """n, mean, sd, min, max, exact median and the t interval of the mean per key."""
    x = F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    return t_interval(base.join(exact_median(df, list(keys), value), list(keys)), ci)


def exact_median(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Exact median per key from running counts of distinct values; no key is gathered in one task."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    below = F.col("rank") - (F.col("n") + 1) / F.lit(2.0)
    placed = midranks(counts, keys, value).join(totals, keys).withColumn("_below", below)
    covers = lambda k: (F.col("_below") < k) & (F.col("_below") + F.col("n") >= k)
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    lower = F.max(F.when(covers(low), F.col(value)))
    upper = F.max(F.when(covers(high), F.col(value)))
    return placed.groupBy(*keys).agg(((lower + upper) / 2.0).alias("median"))


def t_interval(stats: DataFrame, ci: float = 0.95) -> DataFrame:
    """Add ``ci_lo`` / ``ci_hi``; without spread the interval is the mean itself."""
    wide = (F.col("n") > 1) & (F.col("sd") > 0)
    critical = D.student_t_critical(F.lit(1.0 - ci), F.when(wide, (F.col("n") - 1).cast("double")))
    half = F.coalesce(critical * F.col("sd") / F.sqrt(F.col("n")), F.lit(0.0))
    return stats.withColumn("_h", half).withColumns({
        "ci_lo": F.col("mean") - F.col("_h"), "ci_hi": F.col("mean") + F.col("_h")}).drop("_h")


def _side(stats: DataFrame, tier: str, prefix: str, keys: list[str]) -> DataFrame:
    rows = stats.filter(F.col("tier") == tier)
    return rows.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in ("n", "mean", "var")])


def two_sample(stats: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Welch t and Cohen's d of tier ``a`` against ``b`` from ``moments`` rows."""
    j = _side(stats, a, "a", keys).join(_side(stats, b, "b", keys), keys)
    va, vb, na, nb = F.col("a_var"), F.col("b_var"), F.col("a_n"), F.col("b_n")
    pooled = F.when((na > 1) & (nb > 1), F.sqrt((va + vb) / 2.0)).otherwise(F.lit(0.0))
    ea, eb = va / na, vb / nb
    flat = (va == 0) & (vb == 0)
    gap = F.col("a_mean") - F.col("b_mean")
    t = F.when(~flat, gap / F.sqrt(ea + eb))
    dof = F.when(~flat, (ea + eb) * (ea + eb) / (
        F.when(na > 1, ea * ea / (na - 1)).otherwise(F.lit(0.0))
        + F.when(nb > 1, eb * eb / (nb - 1)).otherwise(F.lit(0.0))))
    out = j.withColumns({
        "comparison": F.lit(f"{a} vs {b}"), "mean_diff": gap,
        "cohens_d": F.when(pooled > 0, gap / pooled).otherwise(F.lit(float("nan"))),
        "test": F.when(flat, F.lit("degenerate")).otherwise(F.lit("welch_t")), "t_stat": t, "dof": dof,
    })
    return _with_p(out, keys)


def one_sample(stats: DataFrame, a: str, const_tier: str, keys: list[str]) -> DataFrame:
    """t of tier ``a`` against the mean of a constant tier."""
    j = _side(stats, a, "a", keys).join(_side(stats, const_tier, "b", keys), keys)
    n, var = F.col("a_n"), F.col("a_var")
    flat = (n < 2) | (var == 0)
    gap = F.col("a_mean") - F.col("b_mean")
    out = j.withColumns({
        "comparison": F.lit(f"{a} vs {const_tier}"), "mean_diff": gap,
        "cohens_d": F.lit(None).cast("double"),
        "test": F.when(flat, F.lit("degenerate")).otherwise(F.lit("one_sample_t")),
        "t_stat": F.when(~flat, gap / F.sqrt(var / n)), "dof": F.when(~flat, (n - 1).cast("double")),
    })
    return _with_p(out, keys)


def _with_p(df: DataFrame, keys: list[str]) -> DataFrame:
    out = df.withColumn("p_value", D.student_t_p(F.col("t_stat"), F.col("dof")))
    return out.select(*keys, "comparison", "test", "mean_diff", "cohens_d", "t_stat", "dof", "p_value",
                      (F.col("p_value") < 0.05).alias("significant_p05"))


def significance_table(reps: DataFrame, constant: str, low: str, high: str, metrics: list[str]) -> DataFrame:
    """The three comparisons per metric: high vs low (two-sample), each vs the constant tier."""
    stats = moments(reps.filter(F.col("metric").isin(*metrics)), "tier", "metric")
    mwu = mann_whitney(reps.filter(F.col("metric").isin(*metrics)), high, low, ["metric"]).select(
        "metric", F.col("p_value").alias("mannwhitney_p"))
    welch = two_sample(stats, high, low, ["metric"]).join(mwu, "metric", "left")
    rest = one_sample(stats, low, constant, ["metric"]).unionByName(one_sample(stats, high, constant, ["metric"]))
    return welch.unionByName(rest, allowMissingColumns=True)


def midranks(counts: DataFrame, keys: list[str], value: str = "value", n_buckets: int | None = None) -> DataFrame:
    """Add ``rank`` (mid-rank over all rows) to distinct-value counts ``keys, value, n``.

    A global running count without a global window: values are cut into buckets at
    approximate quantiles, counts are accumulated inside each bucket, and the few bucket
    totals carry the offset. Ties were merged beforehand, so a hot value is one row. Without
    ``n_buckets`` there are a few buckets for each shuffle partition of the session.
    """
    n_buckets = n_buckets or max(64, 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)])
    bounds = counts.groupBy(*keys).agg(F.percentile_approx(value, cuts, max(10_000, 20 * n_buckets)).alias("_cuts"))
    placed = counts.join(bounds, keys).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_total"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.join(totals, [*keys, "_bucket"])
    below = F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return ranked.withColumn("rank", below + (F.col("n") + 1) / F.lit(2.0)).drop("_bucket", "_offset")


def mann_whitney(df: DataFrame, a: str, b: str, keys: list[str], value: str = "value") -> DataFrame:
    """Two-sided U test, normal approximation with tie and continuity correction."""
    x = F.col("tier")
    counts = df.filter(x.isin(a, b) & F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(x == a).alias("na"), F.count_if(x == b).alias("nb"), F.count(F.lit(1)).alias("n"))
    ranked = midranks(counts, keys, value)
    d = F.col("n").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.col("na") * F.col("rank")).alias("rank_sum"),
        F.sum(d * d * d - d).alias("ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u1 = F.col("rank_sum") - na * (na + 1) / 2.0
    total = na + nb
    sigma = F.sqrt(na * nb / 12.0 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    u = F.greatest(u1, na * nb - u1)
    z = (u - na * nb / 2.0 - 0.5) / sigma
    out = sums.filter((na > 0) & (nb > 0)).withColumns({"u_stat": u1, "z": F.when(sigma > 0, z)})
    p = F.least(F.lit(1.0), D.erfc(F.col("z") / F.sqrt(F.lit(2.0))))
    return out.withColumn("p_value", p).select(*keys, "n_a", "n_b", "u_stat", "z", "p_value")


def kappa(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Cohen's kappa of two boolean labels."""
    x, y = F.col(a), F.col(b)
    cells = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"),
        F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))
    n = F.col("n").cast("double")
    po = (F.col("n11") + F.col("n00")) / n
    pe = ((F.col("n11") + F.col("n10")) * (F.col("n11") + F.col("n01")).cast("double")
          + (F.col("n01") + F.col("n00")) * (F.col("n10") + F.col("n00")).cast("double")) / (n * n)
    return cells.withColumns({"observed": po, "expected": pe}).withColumn(
        "kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (F.lit(1.0) - F.col("expected"))))


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key over repeated runs; null counts as a value.

    Ties go to the smallest value, null first. Counts come first, so one very common value is
    reduced before its key is gathered.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col("_n").alias("n")), F.struct(-F.col("_n"), F.col(value)))
    return counts.groupBy(*keys).agg(
        best.alias("_b"), F.sum("_n").alias("n_runs"), F.count(F.lit(1)).alias("n_values")
    ).select(*keys, F.col("_b.v").alias("majority_value"), F.col("_b.n").alias("n_agree"), "n_runs", "n_values",
             (F.col("_b.n") / F.col("n_runs")).alias("agreement"))


def mean_confusion(metrics: DataFrame, names: tuple[str, ...] = ("tp", "fp", "fn", "tn")) -> DataFrame:
    """Mean of each confusion count over the repetitions of a tier: ``tier, metric, mean`` (two places)."""
    rows = metrics.filter(F.col("metric").isin(*names))
    return rows.groupBy("tier", "metric").agg(F.round(F.avg("value"), 2).alias("mean"))
