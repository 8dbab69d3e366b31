"""Model requests and responses: selection, request text, batched calls, strict checks.

The model itself is the caller's: ``client_factory`` builds one client per task and the
client maps request texts to response texts. Everything around it is DataFrame work.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions import verdicts as V
from twinproof.functions.text import is_blank, is_json_object, strip_closed_fence
from twinproof.profile import TRUST_FUND, Profile
from twinproof.session import late_filter

RESPONSE = "response_text string, error string, input_tokens bigint, output_tokens bigint, latency_ms bigint"


def needs_judge() -> Column:
    return F.col("status") == "needs_review"


def judge_inputs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows still in review with text on both sides, and only what a judge may see."""
    rows = late_filter(
        df, needs_judge() & (F.col("final_status") == "needs_review")
        & F.col("contract_raw").isNotNull() & F.col("im_raw").isNotNull())
    extra = [c for c in keys if c != "field"]
    return rows.select(*extra, "field", "label", F.col("contract_raw").alias("contract_raw_text"),
                       F.col("im_raw").alias("im_raw_text"))


def request_json(*columns: str) -> Column:
    """Request text; nulls are spelled out and nothing outside ``columns`` can leak."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def route(profile: Profile = TRUST_FUND) -> Column:
    return V.from_map(F.col("field"), profile.judge_routes, default="generic")


def judge_requests(df: DataFrame, keys: list[str], profile: Profile = TRUST_FUND) -> DataFrame:
    """One request table for all judges: review rows that the policy lets a model decide.

    Maturity requests also carry the same-side reference texts.
    """
    wanted = (F.col("final_status") == "needs_review") & F.coalesce(F.col("judge_allowed"), F.lit(False))
    if "effective_status" in df.columns:
        wanted = wanted & F.col("requires_human_review")
    rows = late_filter(df, wanted)
    rows = rows.withColumns({
        "route": route(profile), "contract_raw_text": F.col("contract_raw"), "im_raw_text": F.col("im_raw"),
    })
    plain = request_json("field", "label", "contract_raw_text", "im_raw_text")
    if "contract_ref_raw" in df.columns:
        rows = rows.withColumns({
            "contract_inception_raw_text": F.col("contract_ref_raw"),
            "im_inception_raw_text": F.col("im_ref_raw"),
        })
        dated = request_json("field", "label", "contract_raw_text", "im_raw_text",
                             "contract_inception_raw_text", "im_inception_raw_text")
        text = F.when(F.col("route") == "maturity", dated).otherwise(plain)
    else:
        text = plain
    extra = [c for c in keys if c != "field"]
    return rows.select(*extra, "field", "route", text.alias("request"))


def support_cases(cases: DataFrame, order: str = "case_id") -> DataFrame:
    """First case per field, except that the first ``match`` outranks any other label.

    ``min_by`` keeps one candidate per task and field, so a huge field costs no sort.
    """
    rank = F.struct((F.col("gold_label") != "match").alias("r"), F.col(order).alias("o"))
    payload = F.struct("case_id", "gold_label", "contract_raw", "im_raw")
    return cases.groupBy("field").agg(F.min_by(payload, rank).alias("_s")).select("field", "_s.*")


def support_texts(cases: DataFrame, profile: Profile = TRUST_FUND, contract: str = "contract_raw",
                  im: str = "im_raw") -> DataFrame:
    """Reference texts for the requests of derived fields: ``field, contract_ref_raw, im_ref_raw``.

    The texts are those of the source field's support case. At most one row a derived field of the
    profile, so the table may be broadcast whatever the number of cases.
    """
    derived = {p.field: p.derive_from for p in profile.policies if p.derive_from}
    rows = cases.filter(F.col("field").isin(*derived.values())).select(
        "case_id", "field", "gold_label", F.col(contract).alias("contract_raw"), F.col(im).alias("im_raw"))
    support = support_cases(rows)
    targets = F.array_compact(F.array(*[
        F.when(F.col("field") == source, F.lit(target)) for target, source in derived.items()]))
    return support.select(F.explode(targets).alias("field"), F.col("contract_raw").alias("contract_ref_raw"),
                          F.col("im_raw").alias("im_ref_raw"))


def call_model(requests: DataFrame, client_factory: Callable[[], Callable[[list[str]], list]],
               max_parallel: int | None = None, text: str = "request") -> DataFrame:
    """Send every request once; a failing request becomes an ``error`` row, not a failed job.

    The client gets a list of texts and returns one item per text: a string, a dict with
    ``text`` / ``input_tokens`` / ``output_tokens``, or an Exception instance.
    """
    source = requests.repartition(max_parallel) if max_parallel else requests
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()
        for batch in batches:
            started = time.perf_counter()
            column = batch.column(names.index(text))
            texts = column.to_pylist()
            try:
                answers = list(client(texts))
                if len(answers) != len(texts):
                    raise ValueError("client returned a wrong number of answers")
            except Exception as exc:  # the batch stays in the result as errors
                answers = [exc] * len(texts)
            spent = int((time.perf_counter() - started) * 1000 / max(len(texts), 1))
            told, errors, given, made = [], [], [], []
            for answer in answers:
                failed, detailed = isinstance(answer, Exception), isinstance(answer, dict)
                whole = answer if detailed else {}
                told.append(whole.get("text") if detailed else None if failed else answer)
                errors.append(str(answer) if failed else None)
                given.append(whole.get("input_tokens"))
                made.append(whole.get("output_tokens"))
            counts = [pa.array(pd.array(v, dtype="Int64")) for v in (given, made, [spent] * len(texts))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(told, column.type), pa.array(errors, column.type), *counts], [*names, *added])

    # Columns besides the request pass through as they are; Python sees the request texts only.
    added = [c.split()[0] for c in RESPONSE.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", " + RESPONSE
    return source.mapInArrow(run, schema).select(*names, *added)


# --- strict response checks -----------------------------------------------------------------------

# Response keys and enumerations per route.
CONFIDENCE = ("high", "medium", "low")
REDEEMABLE = ("yes", "no", "conditional", "unknown")
BASIS = ("absolute_date", "derived_from_inception_duration", "conditional", "unknown")
FEE_STATUS = ("fee_specified", "no_fee", "not_applicable_no_redemption", "conditional_or_exception", "unknown")
EVIDENCE_KEYS = ("confidence", "reason_code", "contract_evidence", "im_evidence", "reason")

RESPONSES = {
    "generic": {"required": ("field", "reason", "status"), "optional": (),
                "enums": {"status": ("same", "different")}, "text": ("reason",)},
    "redeemability": {
        "required": ("field", "contract_redeemable", "im_redeemable", *EVIDENCE_KEYS), "optional": (),
        "enums": {"contract_redeemable": REDEEMABLE, "im_redeemable": REDEEMABLE, "confidence": CONFIDENCE},
        "text": ("reason", "reason_code", "contract_evidence", "im_evidence")},
    "maturity": {
        "required": ("field", "contract_maturity_date", "im_maturity_date", "contract_basis", "im_basis",
                     *EVIDENCE_KEYS), "optional": (),
        "enums": {"contract_basis": BASIS, "im_basis": BASIS, "confidence": CONFIDENCE},
        "text": ("reason", "reason_code", "contract_evidence", "im_evidence")},
    "redemption_fee": {
        "required": ("field", "contract_fee_status", "im_fee_status", *EVIDENCE_KEYS),
        "optional": ("contract_fee_value", "im_fee_value"),
        "enums": {"contract_fee_status": FEE_STATUS, "im_fee_status": FEE_STATUS, "confidence": CONFIDENCE},
        "text": ("reason", "reason_code", "contract_evidence", "im_evidence")},
}


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _response_problem(kind: str) -> Column:
    spec, body, keys = RESPONSES[kind], F.col("_body"), F.col("_keys")
    missing = F.size(F.array_except(_array(spec["required"]), keys)) > 0
    extra = F.size(F.array_except(keys, _array(spec["required"] + spec["optional"]))) > 0
    out = (
        F.when(missing, F.lit("missing_key")).when(extra, F.lit("unknown_key"))
        .when(~F.coalesce(body["field"] == F.col("field"), F.lit(False)), F.lit("field_mismatch"))
    )
    for name, allowed in spec["enums"].items():
        out = out.when(~F.coalesce(body[name].isin(*allowed), F.lit(False)), F.lit(f"bad_value:{name}"))
    for name in spec["text"]:
        out = out.when(F.coalesce(is_blank(body[name]), F.lit(True)), F.lit(f"empty_text:{name}"))
    return out


def read_verdicts(responses: DataFrame) -> DataFrame:
    """Check responses of ``judge_requests`` and resolve them.

    Adds ``problem`` (null when well formed), the parsed answer as a map ``answer`` and
    ``judged`` (same / different / null). A bad or failed response stays a row without verdict.
    """
    staged = responses.withColumn("_text", strip_closed_fence(F.col("response_text")))
    staged = staged.withColumn("_obj", is_json_object(F.col("_text")))
    staged = staged.withColumns({
        "_body": F.when(F.col("_obj"), F.from_json("_text", "map<string,string>")),
    }).withColumn("_keys", F.coalesce(F.map_keys("_body"), F.array().cast("array<string>")))
    problem = F.when(F.col("error").isNotNull(), F.lit("call_failed")).when(
        ~F.coalesce(F.col("_obj"), F.lit(False)), F.lit("not_a_json_object"))
    for kind in RESPONSES:
        problem = problem.when(F.col("route") == kind, _response_problem(kind))
    staged = staged.withColumn("problem", problem)
    a = lambda name: F.col("_body")[name]
    judged = (
        F.when(F.col("problem").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("route") == "redeemability",
              V.resolve_redeemability(a("contract_redeemable"), a("im_redeemable"), a("confidence")))
        .when(F.col("route") == "maturity", V.resolve_maturity(
            a("contract_maturity_date"), a("im_maturity_date"), a("contract_basis"), a("im_basis"), a("confidence")))
        .when(F.col("route") == "redemption_fee", V.resolve_redemption_fee(
            a("contract_fee_status"), a("im_fee_status"), a("contract_fee_value"), a("im_fee_value"), a("confidence")))
        .otherwise(a("status"))
    )
    return staged.withColumns({"judged": judged, "answer": F.col("_body")}).drop("_text", "_obj", "_body", "_keys")


def dead_letters(checked: DataFrame, *keys: str) -> DataFrame:
    """Refused and failed answers, one row each: keys, ``problem`` and everything needed to ask again.

    ``kind`` and ``subject`` are the two parts of the problem (``bad_value`` and ``confidence``).
    """
    subject = F.when(F.contains("problem", F.lit(":")), F.substring_index("problem", ":", -1))
    asked = [c for c in ("request", "response_text", "error") if c in checked.columns]
    # Where the problem is still to be worked out, a plain filter would parse the answer once more for every mention.
    return late_filter(checked, F.col("problem").isNotNull()).select(
        *keys, "problem", F.substring_index("problem", ":", 1).alias("kind"), subject.alias("subject"), *asked)


def usage(responses: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens and latency per key."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return responses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed_calls"),
        total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"),
        (total("input_tokens") + total("output_tokens")).alias("total_tokens"),
        total("latency_ms").alias("latency_ms"),
    )


def baseline_requests(cases: DataFrame, absent: str = "(없음)") -> DataFrame:
    """Stand-alone question per case: label and both texts."""
    fill = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(absent))
    request = F.to_json(F.struct("label", fill("contract_raw").alias("contract"), fill("im_raw").alias("im")))
    return cases.select("case_id", request.alias("request"))
