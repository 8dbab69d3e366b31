"""Cross-checks: raw text first, then canonical values under each field's policy."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions import canonical as C
from twinproof.functions import verdicts as V
from twinproof.functions.literals import lookup
from twinproof.functions.text import same_text
from twinproof.profile import SIDES, TRUST_FUND, Profile, policy_dim
from twinproof.session import late_filter


POLICY_COLUMNS = ("label", "value_type", "canonicalizer", "compare_policy", "judge_allowed", "absence_semantics")


def told_by(values: dict) -> Column:
    """The field's value: a literal where all fields agree, else a map."""
    first = next(iter(values.values()))
    return F.lit(first) if len(set(values.values())) == 1 else lookup(F.col("field"), values)


def with_policy(df: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """Attach policy columns by broadcast; the policy table is configuration-sized.

    A part of a profile needs no join: columns in which its policies agree are literals, the others small maps.
    """
    if profile.whole:
        told = {c: {p.field: getattr(p, c) for p in profile.policies} for c in POLICY_COLUMNS}
        told["ord"] = {p.field: profile.order[p.field] for p in profile.policies}
        return df.withColumns({c: told_by(v) for c, v in told.items() if c not in df.columns})
    dims = policy_dim(df.sparkSession, profile)
    keep = [c for c in dims.columns if c == "field" or c not in df.columns]
    return df.join(dims.select(*keep), "field", "left")


def uncovered_fields(df: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """Fields that occur in the data but have no policy."""
    dims = policy_dim(df.sparkSession, profile).select("field")
    return df.select("field").distinct().join(dims, "field", "left_anti")


@lru_cache(maxsize=64)
def _raw_columns() -> tuple[Column, Column, Column]:
    left, right = F.col("contract_raw"), F.col("im_raw")
    status = (
        F.when(F.col("missing_side") != "none", F.lit("missing_evidence"))
        .when(F.col("_same"), F.lit("exact_match"))
        .otherwise(F.lit("needs_review")))
    return V.missing_side(left, right), F.coalesce(same_text(left, right), F.lit(False)), status


def _raw_state(df: DataFrame) -> DataFrame:
    missing, same, status = _raw_columns()
    return df.withColumns({"missing_side": missing, "_same": same}).withColumn("status", status).drop("_same")


@lru_cache(maxsize=64)
def _raw_reason(index: int) -> Column:
    return V.from_map(F.col("status"), {k: v[index] for k, v in V.RAW_REASONS.items()})


def cross_check_raw(df: DataFrame) -> DataFrame:
    """Missing / exact / needs review from the raw texts alone."""
    return _raw_state(df).withColumns({
        "final_status": F.col("status"),
        "final_reason_code": _raw_reason(0),
        "final_reason": _raw_reason(1),
    })


@lru_cache(maxsize=64)
def _side_probes(side: str) -> tuple[Column, Column, Column, Column]:
    """Probes of a side's text: by its canonicalizer, as a maturity, its months, and the reference date."""
    raw = F.col(f"{side}_raw")
    return (C.value_probe(raw, F.col("canonicalizer"), F.col("absence_semantics")), C.maturity_probe(raw),
            C.months_from_reference(raw), C.date_probe(F.col(f"{side}_ref_raw")))


@lru_cache(maxsize=64)
def _settled_maturity(side: str, has_ref: bool) -> Column:
    return C.settle_maturity(F.col(f"_{side}"), F.col(f"_{side}_m"), F.col(f"_{side}_i") if has_ref else F.lit("dx"))


def settle_sides(df: DataFrame, needed: Column | None = None, derive: bool = True,
                 kinds: tuple[str, ...] = tuple(C.SETTLERS)) -> DataFrame:
    """Add ``_contract`` / ``_im`` settled texts to rows that carry their policy.

    Patterns run in their own projection and only where ``needed`` holds. With ``derive``,
    fields under the maturity canonicalizer use the row's reference cells. ``kinds``: the families of
    probes that can occur.
    """
    needed = F.lit(True) if needed is None else needed
    maturity = (F.col("canonicalizer") == "maturity_date") if derive else F.lit(False)
    has_ref = derive and f"{SIDES[0]}_ref_raw" in df.columns
    probes: dict[str, Column] = {}
    for s in SIDES:
        value, direct, months, ref = _side_probes(s)
        probes[f"_{s}_p"] = F.when(needed, F.when(maturity, direct).otherwise(value))
        if derive:
            probes[f"_{s}_m"] = F.when(needed & maturity, months)
            if has_ref:
                # A date outranks a derivation, so the reference is read for duration texts only.
                probes[f"_{s}_r"] = F.when(
                    needed & maturity & F.col(f"{s}_ref_raw").isNotNull(), ref)
    staged = df.withColumns(probes)
    staged = staged.withColumns({f"_{s}": C.settled(f"_{s}_p", kinds) for s in SIDES} | (
        {f"_{s}_i": C.settled(f"_{s}_r", ("D:",)) for s in SIDES} if has_ref else {}))
    if derive:
        staged = staged.withColumns({
            f"_{s}": F.when(maturity, _settled_maturity(s, has_ref)).otherwise(F.col(f"_{s}"))
            for s in SIDES
        })
    return staged.drop(*[f"_{s}_{x}" for s in SIDES for x in ("p", "r")])


@lru_cache(maxsize=64)
def _equal_values(strict_text: bool) -> Column:
    """Value and unit equality; as text, or as decimals for numeric policies."""
    left, right = F.col("_contract"), F.col("_im")
    value_type = F.col("value_type")
    units = C.unit_of(left, value_type) == C.unit_of(right, value_type)
    same = C.value_of(left) == C.value_of(right)
    if not strict_text:
        number = "decimal(38,18)"
        same = F.when(
            F.col("compare_policy") == "numeric_equal",
            F.coalesce(C.value_of(left).try_cast(number) == C.value_of(right).try_cast(number), same),
        ).otherwise(same)
    return F.coalesce(units & same, F.lit(False))


@lru_cache(maxsize=64)
def _verdict_columns() -> tuple[Column, Column, Column, Column]:
    verdict = (
        F.when(~F.col("_decisive"), F.lit("needs_review"))
        .when(F.col("_equal"), F.lit("same_after_normalization"))
        .otherwise(F.lit("different_after_normalization"))
    )
    return (
        C.is_decisive(F.col("_contract")) & C.is_decisive(F.col("_im")), verdict,
        F.when(F.col("_decisive"), F.lit("decisive")).otherwise(F.lit("non_decisive")),
        F.when(~F.col("_decisive"), F.lit("canonical_not_decisive")).otherwise(
            V.policy_reason(F.col("_equal"), F.col("compare_policy"))))


def compare_values(df: DataFrame, strict_text: bool = True, derive: bool = False,
                   needed: Column | None = None, kinds: tuple[str, ...] = tuple(C.SETTLERS)) -> DataFrame:
    """Canonical comparison of rows with policy columns: ``canonical_*`` and ``_verdict``.

    ``strict_text`` keeps the text of a percent as written (``0.890`` differs from ``0.89``);
    without it numeric policies compare decimals.
    """
    decisive, verdict, status, code = _verdict_columns()
    staged = settle_sides(df, needed, derive, kinds).withColumns({"_decisive": decisive, "_equal": _equal_values(strict_text)})
    return staged.withColumns({"_verdict": verdict, "canonical_status": status, "canonical_reason_code": code})


@lru_cache(maxsize=64)
def _canonical_reason() -> Column:
    noun = F.when(F.col("canonicalizer") == "maturity_date", F.lit("dates")).otherwise(F.lit("values"))
    return (
        F.when(~F.col("_decisive"), F.lit("One or both sides could not be canonicalized decisively."))
        .when(F.col("_equal"), F.concat(F.lit("Canonical "), noun, F.lit(" are equal under field policy.")))
        .otherwise(F.concat(F.lit("Canonical "), noun, F.lit(" differ under field policy.")))
    )


@lru_cache(maxsize=64)
def _side_value(side: str, has_ref: bool) -> Column:
    settled = F.col(f"_{side}")
    metadata = None
    if has_ref:
        metadata = F.when(
            C.code_of(settled) == "md",
            F.create_map(F.lit("inception_date"), C.value_of(F.col(f"_{side}_i")),
                         F.lit("duration_months"), F.col(f"_{side}_m")),
        )
    return C.describe(settled, F.col("value_type"), F.col("field"), metadata)


def _never_decisive(profile: Profile) -> bool:
    """No text of these fields has a canonical value: there is no parser and absence is no value."""
    return bool(profile.whole) and all(
        p.canonicalizer == "none" and p.absence_semantics != "zero_value" for p in profile.policies)


def cross_check_policy(df: DataFrame, profile: Profile = TRUST_FUND, strict_text: bool = True,
                       details: bool = True, open_only: bool = False) -> DataFrame:
    """Missing, then exact, then canonical comparison; row-local apart from the policy lookup.

    ``details`` adds the nested canonical values of both sides. With ``open_only`` only rows come out that are
    still in review after all three; missing and equal texts are dropped before they are parsed.
    """
    staged = _raw_state(with_policy(df, profile))
    needed = F.col("status") == "needs_review"
    if open_only:
        staged = late_filter(staged, needed)
        needed = F.lit(True)
    if _never_decisive(profile) and not details:
        none = F.lit(False)
        _, verdict, status, code = _verdict_columns()
        staged = staged.withColumns({"_decisive": none, "_equal": none}).withColumns(
            {"_verdict": verdict, "canonical_status": status, "canonical_reason_code": code})
    else:
        used = {p.canonicalizer for p in profile.policies}
        kinds = C.families(used) if profile.whole else tuple(C.SETTLERS)
        staged = compare_values(staged, strict_text, not profile.whole or "maturity_date" in used, needed, kinds)
        if open_only:
            staged = late_filter(staged, F.col("_verdict") == "needs_review")
    has_ref = "_contract_i" in staged.columns
    out = staged
    if details:
        canonical = F.struct(
            *[_side_value(s, has_ref).alias(s) for s in SIDES], F.col("judge_allowed").alias("judge_allowed"))
        out = out.withColumn("canonical", F.when(needed, canonical))
    out = out.withColumns({
        "final_status": F.when(needed, F.col("_verdict")).otherwise(F.col("status")),
        "final_reason_code": F.when(needed, F.col("canonical_reason_code")).otherwise(_raw_reason(0)),
        "final_reason": F.when(needed, _canonical_reason()).otherwise(_raw_reason(1)),
        "canonical_status": F.when(needed, F.col("canonical_status")),
        "canonical_reason_code": F.when(needed, F.col("canonical_reason_code")),
        # Only rows that reached the canonical step can go to a judge.
        "judge_allowed": needed & F.col("judge_allowed"),
    })
    inner = [c for c in out.columns if c.startswith("_")]
    policy = ["ord", "value_type", "canonicalizer", "compare_policy", "absence_semantics",
              "range_min", "range_max", "derive_from"]
    return out.drop(*inner, *[c for c in policy if c not in df.columns])


def apply_normalization(df: DataFrame, normalized: DataFrame, keys: list[str]) -> DataFrame:
    """Overlay normalization outcomes; missing and exact rows are never overridden.

    ``normalized`` has ``keys`` + normalization_status, reason_code, reason.
    """
    overlay = normalized.select(
        *keys, F.col("normalization_status").alias("_ns"), F.col("reason_code").alias("_nc"),
        F.col("reason").alias("_nr"))
    joined = df.join(overlay, keys, "left")
    adopt = F.col("_ns").isin("same_after_normalization", "different_after_normalization")
    review = (F.col("status") == "needs_review") & F.col("_ns").isNotNull()
    missing = F.lit("Raw evidence is missing, so normalization cannot override the raw cross-check result.")
    return joined.withColumns({
        "normalization_status": F.col("_ns"),
        "final_status": F.when(review & adopt, F.col("_ns")).when(review, F.lit("needs_review"))
        .otherwise(F.col("final_status")),
        "final_reason_code": F.when(review & adopt, F.col("_nc"))
        .when(review, F.lit("normalization_not_decisive")).otherwise(F.col("final_reason_code")),
        "final_reason": F.when(review & adopt, F.col("_nr"))
        .when(review, F.lit("Normalization did not produce a decisive same or different result."))
        .when((F.col("status") == "missing_evidence") & F.col("_ns").isNotNull(), missing)
        .otherwise(F.col("final_reason")),
    }).drop("_ns", "_nc", "_nr")
