"""Operational review of document pairs: guards, policy, aliases, judge, audit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.operators import compare, constraints, guards, inference, overlay
from twinproof.operators.evidence import flatten, flatten_parts
from twinproof.profile import TRUST_FUND, Profile
from twinproof.session import late_filter, unrolled

STRATEGIES = ("ontology_policy", "ontology_policy_judge")


def review_rows(extractions: DataFrame, keys: list[str], profile: Profile = TRUST_FUND,
                options: guards.GuardOptions = guards.GuardOptions(), details: bool = True) -> DataFrame:
    """Guarded policy comparison of nested extractions; row-local from scan to verdict.

    ``extractions``: keys, ``extraction``, ``contract_pages``, ``im_pages``. It is read once a part of the
    profile. Without ``details`` rows carry no guard events and no nested canonical values.
    """
    carried = [*keys, "contract_pages", "im_pages"]
    if options.use_shapes:
        extractions = guards.with_shape_event(extractions, options=options, profile=profile)
        carried.append("shape_event")

    def check(rows: DataFrame, part: Profile) -> DataFrame:
        return compare.cross_check_policy(guards.apply_guards(rows, options, part, with_events=details), part, details=details)

    return flatten_parts(extractions, carried, check, profile=profile)


def open_rows(extractions: DataFrame, keys: list[str], profile: Profile = TRUST_FUND, judged_only: bool = False) -> DataFrame:
    """The rows of ``review_rows`` that are still in review after the policy, without events and canonical values.

    Every cell is guarded and every pair of texts compared; what is settled on the way (a missing side, equal texts, a
    decisive comparison) leaves at once. The constraint guard comes last: all it does is empty cells of the field itself, which
    settles the row as missing whatever the comparison said, so it need not parse settled rows. No cell of
    an open row is rejected. ``judged_only``: only fields that the policy lets a model decide.
    """
    wanted = tuple(p.field for p in profile.policies if p.judge_allowed or not judged_only)
    carried = [*keys, "contract_pages", "im_pages"]

    def check(rows: DataFrame, part: Profile) -> DataFrame:
        # The whole profile comes (of a stream) with every field.
        rows = rows if part.whole else rows.filter(F.col("field").isin(*wanted))
        cited = guards.apply_guards(rows, guards.GuardOptions(constraint=False), part, with_events=False)
        undecided = compare.cross_check_policy(cited, part, details=False, open_only=True)
        if not part.whole or part.guard_range_fields or part.guard_date_fields:
            undecided = guards.apply_guards(undecided, guards.GuardOptions(citation=False), part, with_events=False)
            undecided = late_filter(undecided, F.col("contract_raw").isNotNull() & F.col("im_raw").isNotNull())
        return undecided.drop("guard_rejections", "guard_caught")

    return flatten_parts(extractions, carried, check, profile=profile, fields=wanted)


def review(extractions: DataFrame, keys: list[str], aliases: DataFrame | None = None,
           verdicts: DataFrame | None = None, strategy: str = "ontology_policy_judge",
           profile: Profile = TRUST_FUND, details: bool = True) -> DataFrame:
    """Review rows with ``effective_status``. ``verdicts`` are resolved judge answers per key+field."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported review strategy: {strategy!r}")
    rows = review_rows(extractions, keys, profile, details=details)
    if aliases is not None:
        rows = overlay.match_aliases(rows, aliases, profile)
    fields = overlay.review_fields(rows)
    if strategy == "ontology_policy_judge" and verdicts is not None:
        fields = overlay.apply_verdicts(fields, verdicts, [*keys, "field"], profile)
    return fields


def judge_fields(fields: DataFrame, keys: list[str], client_factory: Callable, path: str,
                 max_parallel: int | None = None, profile: Profile = TRUST_FUND) -> DataFrame:
    """Call the judge for the rows that need it and store its answers at ``path``.

    Answers are read back from storage: a model is never asked twice because a task is rerun
    downstream.
    """
    requests = inference.judge_requests(fields, [*keys, "field"], profile)
    inference.read_verdicts(inference.call_model(requests, client_factory, max_parallel)).write.mode(
        "overwrite").parquet(path)
    return fields.sparkSession.read.parquet(path)


#: What a stored review row keeps; requests and verdicts need no more.
REVIEW_COLUMNS = ("field", "label", "contract_raw", "im_raw", "contract_ref_raw", "im_ref_raw", "judge_allowed", "final_status",
                  "system_status", "effective_status", "resolution_source", "requires_human_review", "reason_code", "reason")


def settle(fields: DataFrame, keys: list[str], client_factory: Callable, path: str,
           max_parallel: int | None = None, profile: Profile = TRUST_FUND, extra: tuple[str, ...] = ()) -> DataFrame:
    """Review rows with the judge's verdicts.

    The rows (and ``extra`` columns) are stored below ``path`` first, so guards and policy run once and
    the model is asked once; only rows that wait for a verdict meet the answers, all others bypass the join.
    """
    fields.select(*keys, *REVIEW_COLUMNS, *extra).write.mode("overwrite").parquet(f"{path}/rows")
    rows = fields.sparkSession.read.parquet(f"{path}/rows")
    waits = F.coalesce(F.col("requires_human_review") & F.col("judge_allowed"), F.lit(False))
    waiting = rows.filter(waits)
    answers = judge_fields(waiting, keys, client_factory, f"{path}/answers", max_parallel, profile)
    settled = overlay.apply_verdicts(waiting, answers, [*keys, "field"], profile)
    return settled.unionByName(rows.filter(~waits))


def checked_rows(rows: DataFrame, keys: list[str], path: str, *extra: str) -> DataFrame:
    """Compared rows written to ``path`` and read back, with the columns that review rows are made of.

    Alias matching splits rows by their texts; from stored rows that doesn't run guards and parsers once a part.
    """
    made = ("system_status", "effective_status", "resolution_source", "requires_human_review", "reason_code", "reason")
    rows.select(*keys, *[c for c in REVIEW_COLUMNS if c not in made], "final_reason_code", "final_reason", *extra).write.mode(
        "overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def settle_open(extractions: DataFrame, keys: list[str], client_factory: Callable, path: str,
                max_parallel: int | None = None, profile: Profile = TRUST_FUND) -> DataFrame:
    """The rows of ``settle`` that guards and policy leave in review, with the judge's verdicts.

    No verdict puts a settled row back into review, so these are all that open reviews can be counted from.
    """
    rows = overlay.review_fields(open_rows(extractions, keys, profile))
    return settle(rows, keys, client_factory, path, max_parallel, profile)


def judge_answers(extractions: DataFrame, keys: list[str], path: str, client_factory: Callable, aliases: DataFrame | None = None,
                  max_parallel: int | None = None, profile: Profile = TRUST_FUND) -> DataFrame:
    """The ``answers`` of ``operational_review`` for callers that want nothing else of the run.

    Every pair and field that the policy lets a model decide is guarded and compared; rows that wait for a verdict are
    stored, those that an approved alias settles leave, the others are asked about. No events, shapes or review rows.
    """
    rows = open_rows(extractions, keys, profile, judged_only=True)
    if aliases is not None:
        rows = overlay.match_aliases(checked_rows(rows, keys, f"{path}/checked"), aliases, profile)
    return judge_fields(overlay.review_fields(rows), keys, client_factory, f"{path}/answers", max_parallel, profile)


@dataclass(frozen=True)
class ReviewRun:
    """What one review gives; every part reads the same stored rows.

    fields: review rows with ``related_events`` (the guard events of the field). events: the guard
    chain of each pair in order. audit: one row a pair, what the shape rules say. answers: the judge's
    answers (null for the strategy without a judge).
    """

    fields: DataFrame
    events: DataFrame
    audit: DataFrame
    answers: DataFrame | None


def operational_review(extractions: DataFrame, keys: list[str], path: str, client_factory: Callable | None = None,
                       aliases: DataFrame | None = None, strategy: str = "ontology_policy_judge",
                       max_parallel: int | None = None, profile: Profile = TRUST_FUND) -> ReviewRun:
    """The whole review of document pairs: guards with shapes, policy, aliases, judge and audit.

    One scan of the extractions; rows are written below ``path`` (before aliases and before the judge) and everything else starts there.
    An approved alias comes before the judge, a failed or refused answer leaves its row in review.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported review strategy: {strategy!r}")
    if strategy == "ontology_policy_judge" and client_factory is None:
        raise ValueError("this strategy needs a client")
    spark, answers, extra = extractions.sparkSession, None, ("ord", "guard_events")
    rows = review_rows(extractions, keys, profile, guards.GuardOptions(use_shapes=True))
    if aliases is not None:
        rows = overlay.match_aliases(checked_rows(rows, keys, f"{path}/checked", *extra), aliases, profile)
    fields = overlay.review_fields(rows)
    if strategy == "ontology_policy_judge":
        fields = settle(fields, keys, client_factory, path, max_parallel, profile, extra)
        answers = spark.read.parquet(f"{path}/answers")
    else:
        fields.select(*keys, *REVIEW_COLUMNS, *extra).write.mode("overwrite").parquet(f"{path}/rows")
        fields = spark.read.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows").select(*keys, "ord", "guard_events")
    events = guards.explode_events(stored, [*keys, "ord"])
    shape = F.element_at("guard_events", -1)
    audit_rows = stored.filter(F.col("ord") == len(profile.fields) - 1).select(
        *keys, (shape["decision"] == "pass").alias("conforms"), shape["reason_code"].alias("reason_code"),
        F.coalesce(shape["metadata"]["n_violations"].cast("int"), F.lit(0)).alias("n_violations"),
        shape["metadata"]["violations"].alias("violations"))
    related = F.filter("guard_events", lambda e: e["field_path"].isNotNull())
    return ReviewRun(fields.withColumn("related_events", related).drop("guard_events"), events, audit_rows, answers)


def audit(guarded: DataFrame, key: str, profile: Profile = TRUST_FUND) -> tuple[DataFrame, DataFrame]:
    """(violations, conformance) of the guarded evidence as a graph."""
    triples = constraints.raw_triples(guarded, key, profile, structure=True)
    return constraints.shape_violations(triples, profile=profile), constraints.conformance(triples, profile)


def run_mode(extractions: DataFrame, mode: str, profile: Profile = TRUST_FUND) -> DataFrame:
    """What each harness mode produces per pair and field.

    baseline: the extraction alone; ontology: raw comparison; guard: raw comparison after the
    guards. Pairs whose format check failed (``g1_fatal``) drop out of comparison by a filter.
    """
    options = guards.options_for_mode(mode)
    rows = extractions
    if "g1_fatal" in rows.columns:
        rows = rows.filter(~F.col("g1_fatal"))
    long = flatten(rows, ["pair_id", "contract_pages", "im_pages"], profile=profile)
    if mode == "baseline":
        return long
    return compare.cross_check_raw(guards.apply_guards(long, options, profile))


MODES = ("baseline", "ontology", "guard")


def run_modes(documents: DataFrame, keys: list[str], profile: Profile = TRUST_FUND) -> DataFrame:
    """What every harness mode gives for each pair and field.

    ``documents``: keys, ``extraction``, ``contract_pages``, ``im_pages`` and ``attempts``, the raw outputs
    that guard mode validates. Baseline and ontology mode share their rows, which meet no guard; guard mode has rows of its own, so the
    documents are read twice and the outputs validated once. Result: keys, mode, field, ord, g1_fatal, conforms, final_status, final_reason_code,
    guard_caught, guard_events, texts. Baseline has no verdict. A pair whose outputs are all refused is one row
    of guard mode without a field, with the format events.
    """
    carried = [*keys, "contract_pages", "im_pages", "conforms"]
    off = guards.GuardOptions(format=False, citation=False, constraint=False)
    told = ("final_status", "final_reason_code")
    columns = [*keys, "mode", "field", "ord", "g1_fatal", "conforms", *told, "guard_caught", "guard_events", "contract_raw", "im_raw"]

    def shaped(rows: DataFrame, options: guards.GuardOptions) -> DataFrame:
        event = guards.with_shape_event(rows, options=options, profile=profile)
        return event.withColumn("conforms", F.col("shape_event.decision") == "pass").drop("shape_event")

    free = flatten(shaped(documents.drop("attempts"), off), carried, profile=profile)
    free = unrolled(compare.cross_check_raw(guards.apply_guards(free, off, profile)), "mode", F.array(F.lit("baseline"), F.lit("ontology")))
    verdict = F.col("mode") == "ontology"
    free = free.withColumns({c: F.when(verdict, F.col(c)) for c in ("conforms", *told)}).withColumn("g1_fatal", F.lit(False))

    checked = guards.check_format(documents.drop("extraction"), keys, profile=profile).withColumnRenamed("guard_events", "format_events")
    long = flatten(shaped(checked, guards.GuardOptions()), [*carried, "g1_fatal", "format_events"], profile=profile)
    long = long.filter(~F.col("g1_fatal") | (F.col("ord") == 0))
    rows = compare.cross_check_raw(guards.apply_guards(long, profile=profile))
    events = F.when(F.col("ord") == 0, F.concat("format_events", "guard_events")).otherwise(F.col("guard_events"))
    valid = {c: F.when(~F.col("g1_fatal"), F.col(c)) for c in ("field", "conforms", *told)}
    enforced = rows.withColumns({**valid, "guard_events": events, "mode": F.lit("guard")})
    return free.select(*columns).unionByName(enforced.select(*columns))
