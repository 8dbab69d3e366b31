"""Scoring: predictions against labels, confusion metrics and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions import verdicts as V
from twinproof.functions.literals import lookup

# Efficiency index constants, in minutes.
T_MANUAL_MIN, T_AI_MIN, T_REVIEW_MIN = 180.0, 2.5, 2.0

DIMENSIONS = ("field", "difficulty", "mutation_type", "harness_signal")
COUNTS = ("n", "n_correct", "tp", "fp", "fn", "tn", "review", "missing", "hallucinated", "predicted_review")


def classify(df: DataFrame) -> DataFrame:
    """Add ``predicted_label``, ``bucket`` and ``correct`` to labelled predictions."""
    predicted = F.col("predicted_label")
    if "predicted_label" not in df.columns:
        caught = F.col("guard_caught") if "guard_caught" in df.columns else F.lit(False)
        df = df.withColumn("predicted_label", V.predicted_label(F.col("final_status"), caught))
    return df.withColumns({
        "bucket": V.bucket(F.col("gold_label"), predicted),
        "correct": V.is_correct(F.col("gold_label"), predicted),
    })


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion_cells(scored: DataFrame, *keys: str) -> DataFrame:
    """Additive counts per key. Everything below is derived from these few rows."""
    bucket, gold, pred = F.col("bucket"), F.col("gold_label"), F.col("predicted_label")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("n_correct"),
        F.count_if(bucket == "TP").alias("tp"), F.count_if(bucket == "FP").alias("fp"),
        F.count_if(bucket == "FN").alias("fn"), F.count_if(bucket == "TN").alias("tn"),
        F.count_if(bucket == "REVIEW").alias("review"), F.count_if(bucket == "MISSING").alias("missing"),
        F.count_if((gold == "missing") & (pred != "missing")).alias("hallucinated"),
        F.count_if(pred == "review").alias("predicted_review"),
    )


def _p(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def metric_columns(t_manual: float = T_MANUAL_MIN, t_ai: float = T_AI_MIN,
                   t_review: float = T_REVIEW_MIN) -> dict[str, Column]:
    """Metrics over the count columns (unrounded; reports round)."""
    tp, fp, fn, tn, review = (F.col(c) for c in ("tp", "fp", "fn", "tn", "review"))
    p, r = F.col("precision"), F.col("recall")
    minutes = F.lit(t_ai) + fp * F.lit(t_review)
    index = (F.lit(1.0) - minutes / F.lit(t_manual)) * F.lit(100.0) if t_manual > 0 else F.lit(0.0)
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn + review),
        "f1": ratio(F.lit(2.0) * p * r, p + r),
        "f2": ratio(F.lit(5.0) * p * r, F.lit(4.0) * p + r),
        "efficiency_index_pct": index,
        "ai_plus_review_min": minutes,
        "hallucination_rate": ratio(F.col("hallucinated"), F.col("missing")),
        "review_rate": ratio(F.col("predicted_review"), F.col("n")),
    }


def with_metrics(cells: DataFrame, **minutes: float) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns({"precision": _p(tp, fp), "recall": ratio(tp, tp + fn)}).withColumns(
        metric_columns(**minutes)
    )


def score(scored: DataFrame, *keys: str, **minutes: float) -> DataFrame:
    """One metrics row per key (``mode``, ``rep`` ...; none for a single report)."""
    return with_metrics(confusion_cells(scored, *keys), **minutes)


def by_field(scored: DataFrame) -> DataFrame:
    return score(scored, "field").select("field", "n", F.col("n_correct").alias("correct"), "recall", "f1")


def by_difficulty(scored: DataFrame) -> DataFrame:
    return score(scored, "difficulty").select("difficulty", "n", "accuracy", "recall")


def by_mutation(scored: DataFrame) -> DataFrame:
    return score(scored, "mutation_type").select("mutation_type", "n", F.col("tp").alias("caught"), "recall")


def by_signal(scored: DataFrame) -> DataFrame:
    return score(scored, "harness_signal").select(
        "harness_signal", (F.col("tp") + F.col("fn")).alias("expected"), F.col("tp").alias("caught"),
        F.col("recall").alias("hit_rate"),
    )


def breakdowns(scored: DataFrame, *keys: str) -> DataFrame:
    """All breakdowns and the total from one pass over the rows.

    Rows are first reduced to one count row per combination of the dimensions; the grouping
    sets expand that small table instead of the data.
    """
    cells = confusion_cells(scored, *keys, *DIMENSIONS)
    base = [F.col(k) for k in keys]
    sets = [base] + [[*base, F.col(d)] for d in DIMENSIONS]
    rolled = cells.groupingSets(sets, *base, *[F.col(d) for d in DIMENSIONS]).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in COUNTS],
        *[F.grouping(d).alias(f"_{d}") for d in DIMENSIONS],
    )
    block, level = F.lit("total"), F.lit(None).cast("string")
    for d in DIMENSIONS:
        block = F.when(F.col(f"_{d}") == 0, F.lit(d)).otherwise(block)
        level = F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(level)
    return with_metrics(rolled.select(*keys, block.alias("block"), level.alias("level"), *COUNTS))


# --- report tables --------------------------------------------------------------------------

MODE_RANK = {"baseline": 0, "ontology": 1, "guard": 2}
DIFFICULTY_RANK = {"easy": 0, "medium": 1, "hard": 2}


def rank_of(column: Column, ranks: dict[str, int], default: int = 99) -> Column:
    return F.coalesce(lookup(column, ranks), F.lit(default))


def compare_modes(scored: DataFrame) -> DataFrame:
    """One metrics row per mode, in mode order (unknown modes last)."""
    out = score(scored, "mode").withColumn("mode_rank", rank_of(F.col("mode"), MODE_RANK))
    return out.orderBy("mode_rank", "mode")


def recall_by_difficulty(scored: DataFrame, modes: list[str], absent: str = "—") -> DataFrame:
    """Difficulty x mode recall table; a combination that never occurs shows ``absent``."""
    cells = score(scored, "mode", "difficulty")
    shown = F.format_number(F.col("recall"), 3)
    wide = cells.groupBy("difficulty").pivot("mode", modes).agg(F.first(shown))
    table = wide.select("difficulty", *[F.coalesce(F.col(m), F.lit(absent)).alias(m) for m in modes])
    return table.orderBy(rank_of(F.col("difficulty"), DIFFICULTY_RANK), "difficulty")


def condition_summary(conditions: DataFrame, scored: DataFrame) -> DataFrame:
    """Metrics per planned condition; one that never ran stays as ``not_run``."""
    metrics = score(scored, "mode")
    return conditions.join(metrics, "mode", "left").withColumn(
        "state", F.when(F.col("n").isNull(), F.lit("not_run")).otherwise(F.lit("run"))
    )


def status_histogram(df: DataFrame, column: str = "final_status") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def review_summary(fields: DataFrame, *keys: str) -> DataFrame:
    status = F.col("effective_status")
    return fields.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s) for s in ("match", "mismatch", "needs_human_review", "missing_evidence")],
    )


def unmapped_statuses(df: DataFrame, column: str = "final_status") -> DataFrame:
    """Statuses without a predicted label (``unmapped``) and mapped ones that never occur (``unseen``)."""
    from twinproof.operators.setops import symmetric_difference

    known = df.sparkSession.createDataFrame([(s,) for s in V.FINAL_TO_PREDICTED], "status string")
    both = symmetric_difference(df.select(F.col(column).alias("status")), known)
    return both.select("status", F.when(F.col("side") == "left_only", "unmapped").otherwise("unseen").alias("problem"))


def case_rows(scored: DataFrame, *extra: str) -> DataFrame:
    """The per-case block of a score report."""
    return scored.select("case_id", "field", "gold_label", "predicted_label", "correct", "final_status",
                         F.col("final_reason_code").alias("reason_code"), *extra)


def label_problems(cases: DataFrame) -> DataFrame:
    """Duplicate ids, duplicate (field, label), and category / label contradictions."""
    dup_id = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("duplicate_case_id").alias("problem"), F.col("case_id").alias("subject"), "n")
    dup_label = cases.groupBy("field", "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("duplicate_field_label").alias("problem"),
        F.concat_ws("|", "field", "label").alias("subject"), "n")
    normal, mutated = F.col("category") == "정상", F.col("category") == "변조"
    clash = cases.filter(
        (normal & ~F.col("gold_label").isin("match", "missing")) | (mutated & (F.col("gold_label") != "mismatch"))
    ).select(F.lit("category_label_conflict").alias("problem"), F.col("case_id").alias("subject"),
             F.lit(1).cast("bigint").alias("n"))
    return dup_id.unionByName(dup_label).unionByName(clash)
