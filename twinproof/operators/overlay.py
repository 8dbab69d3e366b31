"""Overlays on verdicts: approved aliases, model verdicts, human decisions, and their upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions import verdicts as V
from twinproof.functions.text import alias_key, clip, series_numbers
from twinproof.profile import TRUST_FUND, Profile
from twinproof.session import late_filter


# --- aliases ------------------------------------------------------------------------------------


def with_alias_pair(df: DataFrame, left: str = "contract_raw", right: str = "im_raw",
                    eligible: Column | None = None) -> DataFrame:
    """Add the unordered key pair ``left_norm <= right_norm``; ineligible rows get nulls."""
    eligible = F.lit(True) if eligible is None else eligible
    staged = df.withColumns({
        "_lk": alias_key(F.when(eligible, F.col(left))), "_rk": alias_key(F.when(eligible, F.col(right))),
    })
    return staged.withColumns({
        "left_norm": F.when(F.col("_lk") <= F.col("_rk"), F.col("_lk")).otherwise(F.col("_rk")),
        "right_norm": F.when(F.col("_lk") <= F.col("_rk"), F.col("_rk")).otherwise(F.col("_lk")),
    }).drop("_lk", "_rk")


def match_aliases(df: DataFrame, aliases: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """Flag rows whose unordered text pair is an approved alias of their field.

    Only eligible rows join; the others bypass it, so null keys never pile up in one task. The
    join kind is left to the optimizer, which knows the alias table's size, and to AQE for skew.
    """
    left, right = F.col("contract_raw"), F.col("im_raw")
    eligible = F.coalesce(
        F.col("field").isin(*profile.alias_fields) & (left != "") & (right != ""), F.lit(False))
    approved = aliases.filter(F.col("status") == "approved").select(
        "field", "left_norm", "right_norm").distinct().withColumn("_hit", F.lit(True))
    # Late: a pushed-down filter would run the guards and parsers behind the texts again in its predicate.
    rest = late_filter(df, ~eligible).withColumn("alias_match", F.lit(False))
    hits = with_alias_pair(late_filter(df, eligible)).join(
        approved, ["field", "left_norm", "right_norm"], "left")
    hits = hits.withColumn("alias_match", F.coalesce(F.col("_hit"), F.lit(False))).drop(
        "_hit", "left_norm", "right_norm")
    return rest.unionByName(hits)


def alias_requests(decisions: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """Judge requests to remember an alias: ``alias_outcome`` accepted / no_change / refused_*.

    Input rows: ``run_id, field, decision, contract_raw, im_raw, decided_at``.
    """
    left, right = F.col("contract_raw"), F.col("im_raw")
    blank = (F.coalesce(left, F.lit("")) == "") | (F.coalesce(right, F.lit("")) == "")
    is_series = F.col("field") == (profile.series_field or "")
    staged = with_alias_pair(decisions).withColumns({
        "_ls": F.when(is_series, series_numbers(left)), "_rs": F.when(is_series, series_numbers(right)),
    })
    clash = is_series & (F.size("_ls") > 0) & (F.size("_rs") > 0) & (F.col("_ls") != F.col("_rs"))
    outcome = (
        F.when(F.col("decision") != "same", F.lit("refused_not_same"))
        .when(blank, F.lit("refused_missing_text"))
        .when(~F.col("field").isin(*profile.alias_fields), F.lit("refused_field"))
        .when(F.coalesce(clash, F.lit(False)), F.lit("refused_series_conflict"))
        .when(F.col("left_norm") == F.col("right_norm"), F.lit("no_change"))
        .otherwise(F.lit("accepted"))
    )
    return staged.withColumn("alias_outcome", outcome).drop("_ls", "_rs")


ALIAS_KEY = ("field", "left_norm", "right_norm")


def as_aliases(accepted: DataFrame) -> DataFrame:
    """Accepted requests in the form of the alias table."""
    return accepted.select(
        *ALIAS_KEY, F.col("contract_raw").alias("left_raw"), F.col("im_raw").alias("right_raw"),
        F.col("run_id").alias("source_run_id"), F.lit("approved").alias("status"), F.col("decided_at").alias("created_at"))


def combine_aliases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Table rows and new rows of their keys: first raw texts and creation stay, the source run is the latest.

    ``min_by`` / ``max_by`` combine map-side, so one hot alias is reduced before the shuffle.
    """
    rows = existing.select(*new.columns).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "created_at", "source_run_id", "left_raw", "right_raw")
    return rows.groupBy(*ALIAS_KEY).agg(
        F.min_by("left_raw", order).alias("left_raw"), F.min_by("right_raw", order).alias("right_raw"),
        F.max_by("source_run_id", order).alias("source_run_id"), F.max_by("status", order).alias("status"),
        F.min_by("created_at", order).alias("created_at"))


def upsert_aliases(existing: DataFrame, accepted: DataFrame) -> DataFrame:
    """``existing`` aliases with accepted requests merged in."""
    return combine_aliases(existing, as_aliases(accepted))


# --- decisions ------------------------------------------------------------------------------------

DECISIONS = ("same", "different", "unknown")
MAX_NOTE = 500


def check_decisions(decisions: DataFrame, results: DataFrame) -> DataFrame:
    """Add ``problem`` (null when the decision can be stored).

    ``results(run_id, field)`` lists reviewed fields; a run without rows has no result yet.
    """
    runs = results.select("run_id").distinct().withColumn("_run", F.lit(True))
    fields = results.select("run_id", "field").distinct().withColumn("_field", F.lit(True))
    joined = decisions.join(runs, "run_id", "left").join(fields, ["run_id", "field"], "left")
    problem = (
        F.when(F.col("_run").isNull(), F.lit("no_result"))
        .when(F.col("_field").isNull(), F.lit("unknown_field"))
        .when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), F.lit("unsupported_decision"))
        .when(F.length("note") > MAX_NOTE, F.lit("note_too_long"))
    )
    return joined.withColumn("problem", problem).drop("_run", "_field")


def latest_decisions(decisions: DataFrame, order: str = "decided_at") -> DataFrame:
    """Last decision per (run, field); equal times go to the larger payload.

    The latest time is a plain maximum that tasks combine by hash; only the rows that hold it
    carry their payload into the second aggregation.
    """
    payload = [c for c in decisions.columns if c not in ("run_id", "field")]
    top = decisions.groupBy("run_id", "field").agg(F.max(order).alias("_top"))
    last = decisions.join(top, ["run_id", "field"]).filter(F.col(order).eqNullSafe(F.col("_top"))).drop("_top")
    picked = last.groupBy("run_id", "field").agg(
        F.max_by(F.struct(*payload), F.struct(order, *[c for c in payload if c != order])).alias("_d"))
    return picked.select("run_id", "field", "_d.*")


def apply_decisions(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """Human decisions on top; ``system_status`` never changes, ``unknown`` reopens review."""
    latest = decisions.select("run_id", "field", F.col("decision").alias("_d"))
    joined = fields.join(latest, ["run_id", "field"], "left")
    has = F.col("_d").isNotNull()
    return joined.withColumns({
        "effective_status": F.when(has, V.decision_status(F.col("_d"))).otherwise(F.col("effective_status")),
        "resolution_source": F.when(has, F.lit("human")).otherwise(F.col("resolution_source")),
        "requires_human_review": F.when(has, ~F.col("_d").isin("same", "different")).otherwise(
            F.col("requires_human_review")),
        "human_decision": F.col("_d"),
    }).drop("_d")


# --- review rows ----------------------------------------------------------------------------------

# The stored reasons of a row that an alias settled, and of one without any.
ALIAS_REASON = "An explicitly approved alias pair matched this evidence."
NO_REASON = "No reason was recorded."


def review_fields(compared: DataFrame) -> DataFrame:
    """Comparison rows -> review rows. An approved alias comes before every other verdict.

    ``compared`` carries ``alias_match`` when aliases were looked up.
    """
    hit = F.col("alias_match") if "alias_match" in compared.columns else F.lit(False)
    status = V.effective_status(F.col("final_status"))
    return compared.withColumns({
        "system_status": F.col("final_status"),
        "effective_status": F.when(hit, F.lit("match")).otherwise(status),
        "resolution_source": F.when(hit, F.lit("alias_registry")).otherwise(V.resolution_source(F.col("final_status"))),
        "requires_human_review": ~hit & (status == "needs_human_review"),
        "reason_code": F.when(hit, F.lit("approved_alias_match")).otherwise(
            F.coalesce("final_reason_code", F.lit("unknown"))),
        "reason": F.when(hit, F.lit(ALIAS_REASON)).otherwise(F.coalesce("final_reason", F.lit(NO_REASON))),
    })


# Fixed value: the stored reason of a row that a model settled.
JUDGED_REASON = "The LLM Judge classified the two extracted evidence snippets."


def apply_verdicts(fields: DataFrame, verdicts: DataFrame, keys: list[str], profile: Profile = TRUST_FUND) -> DataFrame:
    """Resolved model verdicts settle rows that still need review and may be judged.

    ``verdicts``: keys + ``judged`` (same / different / null). No verdict leaves the row in review.
    """
    joined = fields.join(verdicts.select(*keys, F.col("judged").alias("_j")), keys, "left")
    use = F.col("requires_human_review") & F.coalesce(F.col("judge_allowed"), F.lit(False)) & F.col("_j").isNotNull()
    special = F.col("field").isin(*profile.judge_routes)
    return joined.withColumns({
        "effective_status": F.when(use & (F.col("_j") == "same"), F.lit("match"))
        .when(use, F.lit("mismatch")).otherwise(F.col("effective_status")),
        "resolution_source": F.when(use, F.lit("llm_judge")).otherwise(F.col("resolution_source")),
        "reason_code": F.when(use & special, F.lit("specialized_high_confidence_judge"))
        .when(use, F.lit("llm_judge_classification")).otherwise(F.col("reason_code")),
        "reason": F.when(use, F.lit(JUDGED_REASON)).otherwise(F.col("reason")),
        "requires_human_review": F.col("requires_human_review") & ~use,
    }).drop("_j")


def run_statuses(fields: DataFrame, reviewed: bool = False) -> DataFrame:
    """Status of each run from its open reviews."""
    open_reviews = F.count_if(F.col("effective_status") == "needs_human_review")
    return fields.groupBy("run_id").agg(open_reviews.alias("open_reviews")).withColumn(
        "status", V.run_status(F.col("open_reviews"), F.lit(reviewed)))


def failed_run(error: Column) -> Column:
    """Stored error text: at most 1000 characters."""
    return clip(error, 1000)


def failed_runs(runs: DataFrame, error: str = "error") -> DataFrame:
    """Failed runs with the stored (clipped) text as ``error`` and the whole one as ``error_text``."""
    return runs.withColumn("error_text", F.col(error)).withColumn("error", failed_run(F.col("error_text")))


def recent_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """Newest runs first; a top-k, so only ``limit`` rows per task travel."""
    return runs.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)
