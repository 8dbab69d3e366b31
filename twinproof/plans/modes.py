"""Evaluation modes over labelled cases: one projection chain each, no shuffle before scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions import verdicts as V
from twinproof.operators import compare, guards, inference
from twinproof.operators.evidence import from_case
from twinproof.profile import TRUST_FUND, Profile

DETERMINISTIC_MODES = ("ontology", "guard", "ontology_policy")


def evaluate(cases: DataFrame, mode: str, contract_pages: int, im_pages: int,
             profile: Profile = TRUST_FUND, strict_text: bool = True) -> DataFrame:
    """Predictions for labelled cases.

    Cases are independent: a maturity case never sees another case's inception date, so the
    reference cells stay empty. The input columns are kept and ``final_status``,
    ``final_reason_code``, ``guard_rejections`` and ``guard_caught`` are added.
    """
    if mode not in DETERMINISTIC_MODES:
        raise ValueError(f"unsupported mode {mode!r} (deterministic modes: {DETERMINISTIC_MODES})")
    rows = guards.with_pages(from_case(cases, profile), contract_pages, im_pages)
    on = mode in ("guard", "ontology_policy")
    rows = guards.apply_guards(rows, guards.GuardOptions(citation=on, constraint=on), profile, with_events=False)
    if mode == "ontology_policy":
        return compare.cross_check_policy(rows, profile, strict_text, details=False)
    return compare.cross_check_raw(rows)


def one_per_case(table: DataFrame, *columns: str) -> DataFrame:
    """At most one row per case, so that an overlay can never multiply cases.

    It shares its shuffle on ``case_id`` with the join that follows.
    """
    row = F.max(F.struct(*columns)).alias("_r")
    return table.groupBy("case_id").agg(row).select("case_id", *[F.col("_r")[c].alias(c) for c in columns])


def evaluate_with_judge(cases: DataFrame, judged: DataFrame, contract_pages: int, im_pages: int,
                        profile: Profile = TRUST_FUND) -> DataFrame:
    """Policy mode plus resolved verdicts ``judged(case_id, judged)`` for the rows in review."""
    rows = evaluate(cases, "ontology_policy", contract_pages, im_pages, profile)
    joined = rows.join(one_per_case(judged, "judged"), "case_id", "left")
    usable = F.when(F.col("judge_allowed"), F.col("judged"))
    settled = (F.col("final_status") == "needs_review") & usable.isNotNull()
    return joined.withColumns({
        "final_reason_code": F.when(settled, F.lit("ontology_policy_judge")).otherwise(F.col("final_reason_code")),
        "final_status": V.resolve_review(F.col("final_status"), usable),
    }).drop("judged")


#: What a stored prediction keeps besides the case's own columns.
JUDGE_COLUMNS = ("case_id", "field", "label", "gold_label", "mutation_type", "difficulty", "harness_signal", "contract_raw", "im_raw",
                 "judge_allowed", "final_status", "final_reason_code", "guard_rejections", "guard_caught")


def judge_mode(cases: DataFrame, contract_pages: int, im_pages: int, client_factory: Callable, path: str,
               max_parallel: int | None = None, profile: Profile = TRUST_FUND) -> tuple[DataFrame, DataFrame]:
    """Policy mode that asks its own judge: (predictions, checked answers).

    Cases are evaluated once and stored below ``path``; requests come from the stored rows in review.
    A derived field's request quotes the texts of its source field's support case, one row that is
    broadcast. Answers are stored before they are used, and only rows in review meet them. A failed or
    refused answer leaves its row in review.
    """
    spark = cases.sparkSession
    given = cases.withColumns({"given_contract": F.col("contract_raw"), "given_im": F.col("im_raw")})
    rows = evaluate(given, "ontology_policy", contract_pages, im_pages, profile)
    rows.select(*[c for c in JUDGE_COLUMNS if c in rows.columns], "given_contract", "given_im").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    waits = F.coalesce((F.col("final_status") == "needs_review") & F.col("judge_allowed"), F.lit(False))
    support = inference.support_texts(rows, profile, "given_contract", "given_im")
    waiting = rows.filter(waits).join(F.broadcast(support), "field", "left")
    requests = inference.judge_requests(waiting, ["case_id", "field"], profile)
    checked = inference.read_verdicts(inference.call_model(requests, client_factory, max_parallel))
    checked.write.parquet(f"{path}/answers")
    answers = spark.read.parquet(f"{path}/answers")
    rows = rows.drop("given_contract", "given_im")
    met = rows.filter(waits).join(one_per_case(answers, "judged"), "case_id", "left")
    settled = met.withColumns({
        "final_reason_code": F.when(F.col("judged").isNotNull(), F.lit("ontology_policy_judge")).otherwise(F.col("final_reason_code")),
        "final_status": V.resolve_review(F.col("final_status"), F.col("judged")),
    }).drop("judged")
    return settled.unionByName(rows.filter(~waits)), answers


def evaluate_full(cases: DataFrame, normalized: DataFrame, judged: DataFrame, contract_pages: int,
                  im_pages: int, profile: Profile = TRUST_FUND) -> DataFrame:
    """Guards, raw check, normalization overlay, then verdicts for what is still in review."""
    rows = evaluate(cases, "guard", contract_pages, im_pages, profile)
    normalized = one_per_case(normalized, "normalization_status", "reason_code", "reason")
    rows = compare.apply_normalization(rows, normalized, ["case_id"])
    rows = rows.join(one_per_case(judged, "judged"), "case_id", "left")
    return rows.withColumns({
        "final_status": V.resolve_review(F.col("final_status"), F.col("judged")),
        "final_reason_code": F.lit("harness_norm_judge"),
    }).drop("judged")


def evaluate_baseline(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Stand-alone verdicts ``answers(case_id, response_text)`` without guards or policies."""
    rows = cases.join(one_per_case(answers, "response_text"), "case_id", "inner")
    verdict = V.parse_verdict(F.col("response_text"))
    return rows.withColumns({
        "verdict": verdict,
        "final_status": V.from_map(verdict, V.VERDICT_TO_FINAL),
        "final_reason_code": F.lit("baseline_llm_verdict"),
        "guard_rejections": F.array().cast("array<string>"),
        "guard_caught": F.lit(False),
    })
