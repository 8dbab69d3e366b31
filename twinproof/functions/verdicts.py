"""Decision ladders: statuses, labels, buckets and model-verdict resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinproof.functions.literals import lookup

# Statuses.
RAW_STATUSES = ("exact_match", "needs_review", "missing_evidence")
FINAL_STATUSES = ("exact_match", "same_after_normalization", "different_after_normalization",
                  "needs_review", "missing_evidence")

# Final status -> predicted label.
FINAL_TO_PREDICTED = {
    "exact_match": "match",
    "same_after_normalization": "match",
    "different_after_normalization": "mismatch",
    "needs_review": "review",
    "missing_evidence": "missing",
}

# Stand-alone verdict -> final status.
VERDICT_TO_FINAL = {
    "match": "exact_match",
    "mismatch": "different_after_normalization",
    "missing": "missing_evidence",
}

# Reasons of the raw comparison.
RAW_REASONS = {
    "exact_match": ("raw_text_exact_match",
                    "Raw text matches exactly after whitespace normalization."),
    "missing_evidence": ("missing_evidence", "One or both sides are missing raw evidence."),
    "needs_review": ("raw_text_difference",
                     "Raw text differs and no decisive normalization result has been applied."),
}

# Compare policy -> word in the reason code.
POLICY_WORD = {"numeric_equal": "numeric_", "date_equal": "date_",
               "duration_equal": "duration_", "boolean_equal": "boolean_"}


def from_map(key: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    out = lookup(key, mapping)
    return out if default is None else F.coalesce(out, F.lit(default))


def missing_side(contract: Column, im: Column) -> Column:
    """Only null is missing; an empty string is evidence here."""
    return (
        F.when(contract.isNull() & im.isNull(), F.lit("both"))
        .when(contract.isNull(), F.lit("contract"))
        .when(im.isNull(), F.lit("im"))
        .otherwise(F.lit("none"))
    )


def policy_reason(same: Column, compare_policy: Column) -> Column:
    word = from_map(compare_policy, POLICY_WORD, default="")
    return F.concat(
        F.lit("canonical_"), word,
        F.when(same, F.lit("equal")).otherwise(F.lit("difference")),
    )


def predicted_label(final_status: Column, guard_caught: Column) -> Column:
    return F.when(guard_caught, F.lit("mismatch")).otherwise(
        from_map(final_status, FINAL_TO_PREDICTED)
    )


def bucket(gold: Column, predicted: Column) -> Column:
    """Confusion cell; gold=match with a missing prediction counts as TN."""
    return (
        F.when(gold == "missing", F.lit("MISSING"))
        .when((gold == "mismatch") & (predicted == "mismatch"), F.lit("TP"))
        .when(gold == "mismatch", F.lit("FN"))
        .when(predicted == "mismatch", F.lit("FP"))
        .when(predicted == "review", F.lit("REVIEW"))
        .otherwise(F.lit("TN"))
    )


def is_correct(gold: Column, predicted: Column) -> Column:
    return F.when(gold == "missing", predicted == "missing").otherwise(
        bucket(gold, predicted).isin("TP", "TN")
    )


def resolve_redeemability(contract: Column, im: Column, confidence: Column) -> Column:
    """``same`` / ``different`` / null when the verdict does not decide."""
    open_end = contract.isin("conditional", "unknown") | im.isin("conditional", "unknown")
    return F.when(
        (confidence == "high") & ~open_end,
        F.when(contract == im, F.lit("same")).otherwise(F.lit("different")),
    )


def resolve_maturity(contract_date: Column, im_date: Column, contract_basis: Column,
                     im_basis: Column, confidence: Column) -> Column:
    open_end = contract_basis.isin("conditional", "unknown") | im_basis.isin("conditional", "unknown")
    dated = (F.coalesce(contract_date, F.lit("")) != "") & (F.coalesce(im_date, F.lit("")) != "")
    return F.when(
        (confidence == "high") & ~open_end & dated,
        F.when(contract_date == im_date, F.lit("same")).otherwise(F.lit("different")),
    )


def resolve_redemption_fee(contract: Column, im: Column, contract_value: Column,
                           im_value: Column, confidence: Column) -> Column:
    open_end = (contract.isin("conditional_or_exception", "unknown")
                | im.isin("conditional_or_exception", "unknown"))
    none_like = ("no_fee", "not_applicable_no_redemption")
    valued = (F.coalesce(contract_value, F.lit("")) != "") & (F.coalesce(im_value, F.lit("")) != "")
    both_priced = (contract == "fee_specified") & (im == "fee_specified")
    return F.when(
        (confidence == "high") & ~open_end,
        F.when(contract.isin(*none_like) & im.isin(*none_like), F.lit("same"))
        .when(both_priced & ~valued, F.lit(None).cast("string"))
        .when(both_priced,
              F.when(contract_value == im_value, F.lit("same")).otherwise(F.lit("different")))
        .when(contract == im, F.lit("same"))
        .otherwise(F.lit("different")),
    )


def resolve_review(final_status: Column, judged: Column) -> Column:
    """A verdict only settles rows that are still in review."""
    return (
        F.when((final_status != "needs_review") | judged.isNull(), final_status)
        .when(judged == "same", F.lit("same_after_normalization"))
        .otherwise(F.lit("different_after_normalization"))
    )


def effective_status(final_status: Column) -> Column:
    return (
        F.when(final_status.isin("exact_match", "same_after_normalization"), F.lit("match"))
        .when(final_status == "different_after_normalization", F.lit("mismatch"))
        .when(final_status == "missing_evidence", F.lit("missing_evidence"))
        .otherwise(F.lit("needs_human_review"))
    )


def resolution_source(final_status: Column) -> Column:
    decided = final_status.isin(
        "exact_match", "same_after_normalization", "different_after_normalization"
    )
    return F.when(decided, F.lit("deterministic")).otherwise(F.lit("unresolved"))


def decision_status(decision: Column) -> Column:
    return (
        F.when(decision == "same", F.lit("match"))
        .when(decision == "different", F.lit("mismatch"))
        .otherwise(F.lit("needs_human_review"))
    )


def parse_verdict(text: Column) -> Column:
    """JSON ``verdict`` first, then a keyword in a fixed order, else missing."""
    named = F.try_variant_get(F.try_parse_json(text), "$.verdict", "string")
    lowered = F.lower(text)
    return (
        F.when(named.isin("match", "mismatch", "missing"), named)
        .when(lowered.contains("mismatch"), F.lit("mismatch"))
        .when(lowered.contains("missing"), F.lit("missing"))
        .when(lowered.contains("match"), F.lit("match"))
        .otherwise(F.lit("missing"))
    )


# --- normalization ----------------------------------------------------------------------

METHODS = ("direct", "derived_from_reference_date", "not_normalized")
FLOAT_TOLERANCE = 0.000001


def normalized_number(text: Column, unit: Column, target: Column) -> Column:
    """Percent or month figure when the unit is the expected one, else null."""
    body = F.trim(text)
    return F.when(
        unit == target,
        F.when((target == "percent_per_year") & body.rlike(r"(?U)^-?\d+(?:\.\d+)?$"),
               body.try_cast("double"))
        .when((target == "month") & body.rlike(r"(?U)^-?\d+$"), body.try_cast("double")),
    )


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYYMMDD``; week dates are not read."""
    body = F.trim(text)
    parts = F.regexp_extract(body, r"^(\d{4})-?(\d{2})-?(\d{2})$", 1)
    dashed = body.rlike(r"^\d{4}-\d{2}-\d{2}$")
    packed = body.rlike(r"^\d{8}$")
    joined = F.when(dashed, body).when(
        packed,
        F.concat_ws("-", F.substring(body, 1, 4), F.substring(body, 5, 2), F.substring(body, 7, 2)),
    )
    return F.when((dashed | packed) & (parts != "0000"), joined.try_cast("date"))


def field_status(contract_ok: Column, im_ok: Column, equal: Column) -> Column:
    return (
        F.when(contract_ok & im_ok & equal, F.lit("same_after_normalization"))
        .when(contract_ok & im_ok, F.lit("different_after_normalization"))
        .when(contract_ok | im_ok, F.lit("partially_normalized"))
        .otherwise(F.lit("normalization_failed"))
    )


# Normalization status -> reason code, reason.
NORMALIZATION_REASONS = {
    "same_after_normalization": ("same_normalized_value",
                                 "Both sides normalize to the same value and unit."),
    "different_after_normalization": (
        "different_normalized_value",
        "Both sides normalized successfully, but the values or units differ."),
    "partially_normalized": ("partial_normalization_success",
                             "Only one side normalized successfully."),
    "normalization_failed": (
        "normalization_failed",
        "Both sides have evidence, but neither side normalized successfully."),
}


def run_status(open_reviews: Column, reviewed: Column) -> Column:
    """``awaiting_review`` while reviews are open, then ``completed`` / ``reviewed``."""
    return (
        F.when(open_reviews > 0, F.lit("awaiting_review"))
        .when(reviewed, F.lit("reviewed"))
        .otherwise(F.lit("completed"))
    )
