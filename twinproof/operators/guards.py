"""Data-quality guards: each emits events and empties the cells it rejects.

The chain is row-local. Events sit in one ``guard_events`` array per row, so the input is
scanned once whether the caller wants verdicts, events or both; unused halves are pruned.
A custom guard is any function ``DataFrame -> DataFrame`` that appends to ``guard_events``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions import canonical as C
from twinproof.functions.literals import gather, lookup
from twinproof.operators.constraints import SHAPE_FIELDS, row_violations
from twinproof.operators.evidence import nullify, validate_extractions
from twinproof.profile import SIDES, TRUST_FUND, Profile
from twinproof.session import late_filter

EVENT = ("struct<guard:string,field_path:string,decision:string,reason_code:string,"
         "reason:string,metadata:map<string,string>>")


@dataclass(frozen=True)
class GuardOptions:
    """Which guards run; ``max_retries`` bounds the alternates tried by the format guard.

    ``use_shapes`` ends the chain with one event a pair about the shape rules (``with_shape_event``).
    """

    format: bool = True
    citation: bool = True
    constraint: bool = True
    max_retries: int = 1
    use_shapes: bool = False


def options_for_mode(mode: str) -> GuardOptions:
    """Only ``guard`` mode enforces; baseline and ontology diagnose."""
    if mode not in ("baseline", "ontology", "guard"):
        raise ValueError(f"invalid mode {mode!r}")
    on = mode == "guard"
    return GuardOptions(format=on, citation=on, constraint=on)


def event(guard: str, path: Column, decision: Column | str, code: Column | str, reason: Column,
          metadata: Column) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.lit(guard).alias("guard"), path.alias("field_path"), lit(decision).alias("decision"),
        lit(code).alias("reason_code"), reason.alias("reason"),
        metadata.cast("map<string,string>").alias("metadata"),
    )


def _meta(**items: Column) -> Column:
    return F.create_map(*[x for k, v in items.items() for x in (F.lit(k), v.cast("string"))])


def _when_set(code: Column, value: Column) -> Column:
    return F.when(code.isNotNull(), F.array(value)).otherwise(F.expr(f"CAST(array() AS array<{EVENT}>)"))


# --- format ---------------------------------------------------------------------------------


def check_format(df: DataFrame, keys: list[str], attempts: str = "attempts",
                 options: GuardOptions = GuardOptions(), profile: Profile = TRUST_FUND) -> DataFrame:
    """Validate raw outputs in order of attempt.

    ``attempts`` is an array of texts: the first output, then alternates for retries. Adds
    ``extraction`` (first valid attempt within the limit, else null), ``g1_fatal``, ``guard_events`` and
    ``violations`` (all problems of every attempt made; event reasons hold 300 characters of them). With the guard off, only the first text is parsed and a failure is
    reported as ``schema_violation_force``.
    """
    limit = 1 + options.max_retries if options.format else 1
    out, done = df, F.lit(False)
    events, results, problems = [], [], []
    for i in range(1, limit + 1):
        # An alternate is parsed only where no earlier attempt was valid.
        text = F.try_element_at(F.col(attempts), F.lit(i))
        text = F.when(~done, text) if i > 1 else text
        out = validate_extractions(
            out.withColumn("_text", text), "_text", profile, fenced=options.format
        ).withColumnsRenamed({"violations": f"_v{i}", "extraction": f"_x{i}"}).drop("_text")
        tried = ~done & (text.isNotNull() if i > 1 else F.lit(True))
        valid = F.col(f"_x{i}").isNotNull()
        reason = F.substring(F.array_join(F.col(f"_v{i}"), "; "), 1, 300)
        if options.format:
            failed = event("G1", F.lit(None).cast("string"), "retry" if i < limit else "reject",
                           "schema_violation", reason, _meta(attempt=F.lit(i)))
            passed = event("G1", F.lit(None).cast("string"), "pass",
                           "json_valid" if i == 1 else "json_valid_after_retry",
                           F.lit(f"schema validation passed (attempt={i})"), _meta(attempt=F.lit(i)))
            events.append(F.when(tried, F.when(valid, passed).otherwise(failed)))
        else:
            failed = event("G1", F.lit(None).cast("string"), "reject", "schema_violation_force",
                           reason, _meta(forced=F.lit(True)))
            events.append(F.when(~valid, failed))
        results.append(F.when(tried & valid, F.col(f"_x{i}")))
        problems.append(F.when(tried, F.col(f"_v{i}")))
        done = done | (tried & valid)
        # Without an alternate the chain stops after its first retry event.
        if i < limit:
            done = done | F.try_element_at(F.col(attempts), F.lit(i + 1)).isNull()
    return out.select(
        *[c for c in df.columns],
        F.coalesce(*results).alias("extraction"),
        F.coalesce(*results).isNull().alias("g1_fatal"),
        F.array_compact(F.array(*events)).cast(f"array<{EVENT}>").alias("guard_events"),
        F.array_compact(F.array(*problems)).alias("violations"),
    )


# --- citation and constraint ------------------------------------------------------------------


def _citation_code(side: str, profile: Profile, page: Column, doc: Column) -> Column:
    inside = (page >= 1) & (page <= F.col(f"{side}_pages"))
    return F.when(
        page.isNotNull(),
        F.when(~inside, F.lit("page_out_of_range"))
        .when(~doc.eqNullSafe(F.lit(profile.documents[side])), F.lit("citation_document_mismatch"))
        .otherwise(F.lit("page_in_range")),
    )


def _rejected(code: Column) -> Column:
    return code.isin("page_out_of_range", "citation_document_mismatch")


@lru_cache(maxsize=64)
def _citation_event(side: str, expected: str) -> Column:
    code, page, pages = F.col(f"_g2_{side}"), F.col(f"_{side}_page0"), F.col(f"{side}_pages")
    doc = F.col(f"_{side}_doc0")
    mismatch = code == "citation_document_mismatch"
    span = F.concat(F.lit(" [1, "), pages.cast("string"), F.lit("]"))
    reason = (
        F.when(code == "page_out_of_range", F.concat(F.lit("page "), page.cast("string"), F.lit(" ∉"), span))
        .when(mismatch, F.concat(F.lit(f"side={side} but citation.document="), doc))
        .otherwise(F.concat(F.lit("page "), page.cast("string"), F.lit(" ∈"), span))
    )
    meta = F.when(
        mismatch, _meta(expected=F.lit(expected), actual=doc, side=F.lit(side))
    ).otherwise(_meta(page=page, max_page=pages, side=F.lit(side)))
    return _when_set(code, event(
        "G2", F.concat(F.col("field"), F.lit(f".{side}")),
        F.when(_rejected(code), F.lit("reject")).otherwise(F.lit("pass")), code, reason, meta))


def _where(where: Column | None, value: Column) -> Column:
    return value if where is None else F.when(where, value)


def check_citations(df: DataFrame, profile: Profile = TRUST_FUND, where: Column | None = None) -> DataFrame:
    """Citation page inside the document, and document on the right side.

    Rows outside ``where`` pass unchecked. Needs ``<side>_pages``. Reads the input cells; rejected cells (and rejected reference
    cells, which are other fields' cells of the same side) come out empty.
    """
    codes = {}
    for s in SIDES:
        codes[f"_g2_{s}"] = _where(where, _citation_code(s, profile, F.col(f"{s}_page"), F.col(f"{s}_doc")))
        codes[f"_{s}_page0"], codes[f"_{s}_doc0"] = F.col(f"{s}_page"), F.col(f"{s}_doc")
        if f"{s}_ref_page" in df.columns:
            codes[f"_g2_{s}_ref"] = _where(where, _citation_code(s, profile, F.col(f"{s}_ref_page"), F.col(f"{s}_ref_doc")))
    out = df.withColumns(codes)
    for s in SIDES:
        out = nullify(out, s, _rejected(F.col(f"_g2_{s}")))
        if f"{s}_ref_page" in df.columns:
            out = nullify(out, f"{s}_ref", _rejected(F.col(f"_g2_{s}_ref")))
    return out


def _among(names: tuple[str, ...], profile: Profile) -> Column:
    """Is the row's field one of these? A literal in a part of a profile that has none or only such fields."""
    if profile.whole and set(names) in (set(), set(profile.fields)):
        return F.lit(bool(names))
    return F.col("field").isin(*names)


def _range_dims(profile: Profile, bound: str) -> Column:
    if not profile.guard_range_fields:
        return F.lit(None).cast("double")
    return lookup(F.col("field"), {f: getattr(profile.policy(f), bound) for f in profile.guard_range_fields})


@lru_cache(maxsize=64)
def _percent_of(probe: str) -> Column:
    return C.guard_percent_value(F.col(probe))


@lru_cache(maxsize=64)
def _date_of(probe: str) -> Column:
    return C.guard_date_value(F.col(probe))


def check_constraints(df: DataFrame, profile: Profile = TRUST_FUND, where: Column | None = None) -> DataFrame:
    """Numeric range, date note, and later-after-earlier order per side; rows outside ``where`` pass unchecked."""
    on = F.lit(True) if where is None else where
    is_fee = on & _among(profile.guard_range_fields, profile)
    is_date = on & _among(profile.guard_date_fields, profile)
    is_later = on & _among((profile.order_later,) if profile.order_later else (), profile)
    first = {}
    for s in SIDES:
        raw = F.col(f"{s}_raw")
        first[f"_{s}_raw0"] = raw
        first[f"_{s}_probe"] = F.when(is_fee, C.guard_percent_probe(raw)).when(
            is_date, C.guard_date_probe(raw))
        if f"{s}_ref_raw" in df.columns:
            first[f"_{s}_ref_probe"] = F.when(
                is_later & raw.isNotNull(), C.guard_date_probe(F.col(f"{s}_ref_raw")))
    out = df.withColumns({"_lo": _range_dims(profile, "range_min"),
                          "_hi": _range_dims(profile, "range_max"), **first})
    second = {}
    for s in SIDES:
        second[f"_{s}_pct"] = F.when(is_fee, _percent_of(f"_{s}_probe"))
        second[f"_{s}_date"] = F.when(is_date, _date_of(f"_{s}_probe"))
        if f"{s}_ref_raw" in df.columns:
            second[f"_{s}_ref_date"] = _date_of(f"_{s}_ref_probe")
    out = out.withColumns(second)
    codes = {}
    for s in SIDES:
        pct, raw = F.col(f"_{s}_pct"), F.col(f"{s}_raw")
        codes[f"_g3a_{s}"] = F.when(
            raw.isNotNull() & is_fee,
            F.when(pct.isNull(), F.lit("unit_not_recognized"))
            .when(~pct.between(F.col("_lo"), F.col("_hi")), F.lit("percent_range"))
            .otherwise(F.lit("percent_in_range")),
        ).when(
            raw.isNotNull() & is_date,
            F.when(F.col(f"_{s}_date").isNull(), F.lit("date_unparseable")).otherwise(F.lit("date_parsed")),
        )
        later = F.col(f"_{s}_date")
        earlier = F.col(f"_{s}_ref_date") if f"{s}_ref_raw" in df.columns else F.lit(None).cast("string")
        codes[f"_g3c_{s}"] = F.when(
            is_later & later.isNotNull() & earlier.isNotNull(),
            F.when(later <= earlier, F.lit("maturity_not_after_inception"))
            .otherwise(F.lit("maturity_after_inception")),
        )
        codes[f"_{s}_earlier"] = earlier
    out = out.withColumns(codes)
    for s in SIDES:
        bad = (F.col(f"_g3a_{s}") == "percent_range") | F.coalesce(
            F.col(f"_g3c_{s}") == "maturity_not_after_inception", F.lit(False))
        out = nullify(out, s, bad)
    return out


@lru_cache(maxsize=64)
def _range_event(side: str) -> Column:
    code, pct, raw = F.col(f"_g3a_{side}"), F.col(f"_{side}_pct"), F.col(f"_{side}_raw0")
    lo, hi, date = F.col("_lo"), F.col("_hi"), F.col(f"_{side}_date")
    span = F.concat(F.lit(" ["), lo.cast("string"), F.lit(", "), hi.cast("string"), F.lit("]"))
    text = pct.cast("string")
    reason = (
        F.when(code == "unit_not_recognized", F.lit("unit not recognized, range check skipped"))
        .when(code == "percent_range", F.concat(text, F.lit("% ∉"), span))
        .when(code == "percent_in_range", F.concat(text, F.lit("% ∈"), span))
        .when(code == "date_unparseable", F.lit("date not recognized, check skipped"))
        .otherwise(F.concat(F.lit("parsed="), date))
    )
    meta = (
        F.when(code.isin("unit_not_recognized", "date_unparseable"), _meta(raw_text=raw))
        .when(code == "percent_range", _meta(value_pct=pct, min=lo, max=hi, raw_text=raw))
        .when(code == "percent_in_range", _meta(value_pct=pct))
        .otherwise(_meta(date=date))
    )
    return _when_set(code, event(
        "G3", F.concat(F.col("field"), F.lit(f".{side}")),
        F.when(code == "percent_range", F.lit("reject")).otherwise(F.lit("pass")), code, reason, meta))


@lru_cache(maxsize=64)
def _order_event(side: str) -> Column:
    code, later, earlier = F.col(f"_g3c_{side}"), F.col(f"_{side}_date"), F.col(f"_{side}_earlier")
    bad = code == "maturity_not_after_inception"
    reason = F.concat(F.lit("maturity="), later,
                      F.when(bad, F.lit(" ≤ inception=")).otherwise(F.lit(" > inception=")), earlier)
    meta = F.when(bad, _meta(inception=earlier, maturity=later, side=F.lit(side))).otherwise(
        _meta(inception=earlier, maturity=later))
    return _when_set(code, event(
        "G3", F.concat(F.col("field"), F.lit(f".{side}")),
        F.when(bad, F.lit("reject")).otherwise(F.lit("pass")), code, reason, meta))


# --- shapes -------------------------------------------------------------------------------------


def _kept_texts(df: DataFrame, extraction: str, paths: tuple[str, ...], options: GuardOptions,
                profile: Profile, where: Column | None) -> DataFrame:
    """Raw texts of a pair's cells as the citation and constraint guards leave them, as ``_t<path>_<side>``."""
    cells = {(p, s): f"_t{i}_{s}" for i, p in enumerate(paths) for s in SIDES}
    keep = lambda bad, text: F.when(~F.coalesce(_where(where, bad), F.lit(False)), text)
    first = {}
    for (path, s), name in cells.items():
        if path not in profile.fields:
            first[name] = F.lit(None).cast("string")
            continue
        cell = F.col(f"{extraction}.{path}")[s]
        text, cite = cell["raw_text"], cell["citation"]
        first[name] = keep(_rejected(_citation_code(s, profile, cite["page"], cite["document"])), text) if options.citation else text
    out = df.withColumns(first)
    if not options.constraint:
        return out
    order = (profile.order_earlier, profile.order_later)
    fees = {k: n for k, n in cells.items() if k[0] in profile.guard_range_fields}
    dates = {k: n for k, n in cells.items() if k[0] in order}
    out = out.withColumns({**{f"{n}_p": C.guard_percent_probe(F.col(n)) for n in fees.values()},
                           **{f"{n}_p": C.guard_date_probe(F.col(n)) for n in dates.values()}})
    out = out.withColumns({**{f"{n}_v": C.guard_percent_value(F.col(f"{n}_p")) for n in fees.values()},
                           **{f"{n}_v": C.guard_date_value(F.col(f"{n}_p")) for n in dates.values()}})
    bad = {n: ~F.col(f"{n}_v").between(profile.policy(p).range_min, profile.policy(p).range_max) for (p, _), n in fees.items()}
    for s in SIDES:
        if (order[0], s) in dates and (order[1], s) in dates:
            bad[dates[order[1], s]] = F.col(f"{dates[order[1], s]}_v") <= F.col(f"{dates[order[0], s]}_v")
    return out.withColumns({n: keep(b, F.col(n)) for n, b in bad.items()})


def with_shape_event(df: DataFrame, extraction: str = "extraction", options: GuardOptions = GuardOptions(),
                     profile: Profile = TRUST_FUND, where: Column | None = None) -> DataFrame:
    """Nested extractions with ``shape_event``: what the shape rules say of each pair's guarded cells.

    Outside ``where`` the rules see the cells unguarded. Needs ``<side>_pages``. Row-local: the rules read the pair's own cells, no graph is built. Nothing is
    emptied by a broken rule; ``metadata`` lists all of them.
    """
    names = {(p, s): f"_t{i}_{s}" for i, p in enumerate(SHAPE_FIELDS) for s in SIDES}
    staged = _kept_texts(df, extraction, SHAPE_FIELDS, options, profile, where).withColumn(
        "_broken", row_violations(lambda path, side: F.col(names[path, side])))
    broken, ok = F.col("_broken"), F.size("_broken") == 0
    report = F.array_join(F.transform(broken, lambda v: F.concat_ws(" ", v["focus"], v["constraint"])), "; ")
    told = event(
        "G3", F.lit(None).cast("string"), F.when(ok, F.lit("pass")).otherwise(F.lit("reject")),
        F.when(ok, F.lit("shacl_conforms")).otherwise(F.lit("shacl_violation")),
        F.when(ok, F.lit("all shape rules hold")).otherwise(F.concat(F.size(broken).cast("string"), F.lit(" shape rules broken"))),
        F.when(ok, F.create_map().cast("map<string,string>")).otherwise(_meta(n_violations=F.size(broken), violations=report)))
    return staged.select(*df.columns, told.alias("shape_event"))


def apply_guards(df: DataFrame, options: GuardOptions = GuardOptions(),
                 profile: Profile = TRUST_FUND, with_events: bool = True, where: Column | None = None,
                 count_events: bool = False) -> DataFrame:
    """Citation then constraint guards over long evidence rows, and the pair's shape event last.

    ``where`` limits both guards to some rows; the others come out as they are, without events.

    With ``use_shapes`` the rows carry ``shape_event`` and ``ord``; the event goes to the last field's row. Adds ``guard_events``, ``guard_rejections`` (``G2:page_out_of_range`` ...) and
    ``guard_caught``. Cells emptied by the citation guard are invisible to the next one.
    Callers that only score leave the events out (``with_events=False``). ``count_events`` adds ``n_events``, the
    number of the row's own events (not the shape event), without building them.
    """
    out, events, rejections, codes = df, [], [], []
    shapes = options.use_shapes and with_events
    if shapes and "shape_event" not in df.columns:
        raise ValueError("with_shape_event comes before the rows are flattened")
    if options.citation:
        out = check_citations(out, profile, where)
        codes += [f"_g2_{s}" for s in SIDES]
        events += [_citation_event(s, profile.documents[s]) for s in SIDES] if with_events else []
        rejections += [
            F.when(_rejected(F.col(f"_g2_{s}")), F.concat(F.lit("G2:"), F.col(f"_g2_{s}"))) for s in SIDES
        ]
    # A part of a profile without ranges and dates has nothing to check.
    if options.constraint and (not profile.whole or profile.guard_range_fields or profile.guard_date_fields):
        out = check_constraints(out, profile, where)
        codes += [f"_{g}_{s}" for g in ("g3a", "g3c") for s in SIDES]
        if with_events:
            events += [_range_event(s) for s in SIDES] + [_order_event(s) for s in SIDES]
        rejections += [F.when(F.col(f"_g3a_{s}") == "percent_range", F.lit("G3:percent_range")) for s in SIDES]
        rejections += [
            F.when(F.col(f"_g3c_{s}") == "maturity_not_after_inception",
                   F.lit("G3:maturity_not_after_inception"))
            for s in SIDES
        ]
    last = max(profile.order.values())
    if shapes and last in (profile.order[f] for f in profile.fields):
        events.append(_when_set(F.when(F.col("ord") == last, F.lit(True)), F.col("shape_event")))
    if count_events:
        out = out.withColumn("n_events", sum((F.col(c).isNotNull().cast("int") for c in codes), F.lit(0)))
    inner = [c for c in out.columns if c.startswith("_")] + ["shape_event"]
    if not rejections:
        empty = F.array()
        return out.withColumns({
            "guard_events": (F.concat(*events) if events else empty).cast(f"array<{EVENT}>"),
            "guard_rejections": empty.cast("array<string>"), "guard_caught": F.lit(False),
        }).drop(*inner)
    added = {
        "guard_rejections": gather(rejections, "string"),
        "guard_caught": F.coalesce(*rejections).isNotNull(),
    }
    if with_events:
        added["guard_events"] = F.concat(*events).cast(f"array<{EVENT}>")
    return out.withColumns(added).drop(*inner)


def with_pages(df: DataFrame, contract_pages: int, im_pages: int) -> DataFrame:
    """Same page counts for every pair."""
    return df.withColumns({"contract_pages": F.lit(contract_pages), "im_pages": F.lit(im_pages)})


def attach_pages(df: DataFrame, documents: DataFrame, key: str = "pair_id") -> DataFrame:
    """Page counts per pair from ``documents(key, side, pages)``: one pivoted row per pair."""
    pages = documents.groupBy(key).agg(*[
        F.max(F.when(F.col("side") == s, F.col("pages"))).cast("int").alias(f"{s}_pages") for s in SIDES
    ])
    return df.join(pages, key, "left")


def explode_events(df: DataFrame, keys: list[str]) -> DataFrame:
    # The outer variant keeps the optimizer from evaluating the array twice for a size filter.
    rows = df.select(*keys, F.explode_outer("guard_events").alias("_e")).filter(F.col("_e").isNotNull())
    return rows.select(*keys, "_e.*")


def parent_field(path: Column) -> Column:
    """Event path -> field: the side suffix is dropped; a null path stays null."""
    return F.regexp_replace(path, r"\.(contract|im)$", "")


def rejections_by_field(events: DataFrame, keys: list[str]) -> DataFrame:
    """``G2:code`` lists per (keys, field); bounded by two sides times the guards' rules."""
    return (
        events.filter((F.col("decision") == "reject") & F.col("field_path").isNotNull())
        .withColumn("field", parent_field(F.col("field_path")))
        .groupBy(*keys, "field")
        .agg(F.array_sort(F.collect_list(F.concat_ws(":", "guard", "reason_code"))).alias("guard_rejections"))
    )


def rejected_fields(guarded: DataFrame, keys: list[str]) -> DataFrame:
    """``rejections_by_field`` from guarded rows themselves: only rows with a rejection are gathered, no event is built."""
    caught = late_filter(guarded.select(*keys, "field", "guard_caught", "guard_rejections"), F.col("guard_caught"))
    return caught.groupBy(*keys, "field").agg(
        F.array_sort(F.flatten(F.collect_list("guard_rejections"))).alias("guard_rejections"))


def count_by_field(guarded: DataFrame, keys: list[str]) -> DataFrame:
    """Number of (row, event) matches per keys and field, from rows guarded with ``count_events``.

    An event's field is its row's, so nothing is joined. Rows that repeat a key match each other's events too.
    """
    return guarded.groupBy(*keys, "field").agg((F.count(F.lit(1)) * F.sum("n_events")).cast("bigint").alias("n_events"))


def attach_events(df: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join of events to their field (prefix match resolved by ``parent_field``)."""
    grouped = (
        events.filter(F.col("field_path").isNotNull())
        .withColumn("field", parent_field(F.col("field_path")))
        .groupBy(*keys, "field")
        .agg(F.array_sort(F.collect_list(F.struct("guard", "field_path", "decision", "reason_code")))
             .alias("related_events"))
    )
    return df.join(grouped, [*keys, "field"], "left")


def summarize_events(events: DataFrame) -> DataFrame:
    """Events by guard and decision with explicit zeros, plus totals on every row."""
    decisions = ("pass", "reject", "retry")
    return events.groupBy("guard").agg(
        *[F.count_if(F.col("decision") == d).alias(d if d != "pass" else "passed") for d in decisions],
        F.count(F.lit(1)).alias("total_events"),
    )
