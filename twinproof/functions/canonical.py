"""Canonical forms of percent, date, duration and boolean notations.

Parsing takes two steps, which operators put in consecutive projections as plain string
columns, so a pattern runs once per cell however often its outcome is used:

* a *probe* runs one regular expression whose ordered alternatives are the notations, and
  keeps only the matched figures;
* ``settle`` turns the probe into a two-letter outcome code followed by the value
  (``pm0.89``, ``da2025-07-22``, ``px``) with cheap work on short strings.

``describe`` widens a settled text to the full canonical value when a caller wants it.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions.literals import lookup
from twinproof.functions.text import WS, fold_digits, is_blank

# Notation patterns.
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
PERCENT = rf"({NUMBER})[\s\x1c-\x1f\[\]()]*%"
PERMILLE = rf"(?:1[,，]?000|1000|1{WS}*천){WS}*분의{WS}*({NUMBER})"
BASIS_POINT = rf"({NUMBER}){WS}*(?i:bps|bp|basis{WS}*points?)"
BARE_NUMBER = rf"({WS}*{NUMBER}{WS}*\z)"
DATE_DASH, DATE_DOT, DATE_SLASH = (rf"\d{{4}}{sep}\d{{1,2}}{sep}\d{{1,2}}" for sep in ("-", r"\.", "/"))
DATE_KOREAN = rf"\d{{4}}{WS}*년{WS}*\d{{1,2}}{WS}*월{WS}*\d{{1,2}}{WS}*일"
YEARS = rf"(?U)([0-9]+){WS}*년"
MONTHS = rf"(?U)([0-9]+){WS}*개월"
GUARD_PERMILLE = rf"1[,，]?000{WS}*분의{WS}*({NUMBER})"

# Ordered alternatives: a later notation is tried only when no earlier one occurs anywhere.
# The empty last alternative makes the whole text match, so the replacement is the probe.
PERCENT_LADDER = rf"(?sU)^(?:.*?{PERCENT}|.*?{PERMILLE}|.*?{BASIS_POINT}|{BARE_NUMBER}|).*"
DATE_LADDER = rf"(?sU)^(?:.*?({DATE_DASH})|.*?({DATE_DOT})|.*?({DATE_SLASH})|.*?({DATE_KOREAN})|).*"
GUARD_PERCENT_LADDER = rf"(?sU)^(?:.*?{PERCENT}|.*?{GUARD_PERMILLE}|).*"
# Each look-ahead is optional and independent: a leading ISO-like date (all of the first ten
# characters) and a Korean date anywhere are reported side by side.
GUARD_DATE_PARTS = (
    rf"(?sU)^(?:(?={WS}*(\d{{4}}([-/])\d{{1,2}}\2\d{{1,2}}){WS}*\z)|(?={WS}*(\d{{4}}([-/])\d{{2}}\4\d{{2}}))|)"
    rf"(?:(?=.*?({DATE_KOREAN}))|).*"
)

# Word lists.
ABSENCE_WORDS = ("없음", "해당없음", "해당사항없음", "부과하지아니함", "면제")
NEGATIVE_WORDS = ("불가", "불가능", "없음", "아니", "제한")
POSITIVE_WORDS = ("가능", "허용", "할수있")
REFERENCE_WORDS = ("설정일", "최초설정일")

# Outcome code -> (status, unit, method, reason_code, reason).
OUTCOMES = {
    "m0": ("non_decisive", None, None, "missing_raw_text", "Raw text is missing."),
    "m1": ("non_decisive", None, None, "missing_raw_text", "Raw text is empty."),
    "az": ("decisive", "*", "absence_zero", "absence_as_zero",
           "Absence expression is configured as zero value for this field."),
    "am": ("non_decisive", None, None, "absence_as_missing",
           "Absence expression is configured as missing evidence for this field."),
    "pc": ("decisive", "percent_per_year", "percent", "percent_unit", "Explicit percent unit."),
    "pm": ("decisive", "percent_per_year", "permille", "permille_unit",
           "Explicit permille expression."),
    "bp": ("decisive", "percent_per_year", "basis_point", "basis_point_unit",
           "Explicit basis point unit."),
    "pu": ("non_decisive", None, None, "percent_unit_missing",
           "Unitless numeric percent evidence is ambiguous."),
    "px": ("non_decisive", None, None, "percent_unparseable",
           "No explicit percent, permille, or basis point unit was found."),
    "da": ("decisive", "date", "absolute_date", "date_parsed", "Absolute date parsed."),
    "dk": ("decisive", "date", "korean_date", "date_parsed", "Absolute date parsed."),
    "di": ("non_decisive", None, None, "date_invalid",
           "Date components do not form a valid date."),
    "dx": ("non_decisive", None, None, "date_unparseable",
           "No supported absolute date expression was found."),
    "du": ("decisive", "months", "duration", "duration_parsed", "Duration parsed as months."),
    "dn": ("non_decisive", None, None, "duration_unparseable",
           "No supported duration expression was found."),
    "bf": ("decisive", "boolean", "boolean", "boolean_false", "Negative boolean expression."),
    "bt": ("decisive", "boolean", "boolean", "boolean_true", "Positive boolean expression."),
    "bx": ("non_decisive", None, None, "boolean_unparseable",
           "No supported boolean expression was found."),
    "nc": ("non_decisive", None, None, "canonicalizer_not_configured",
           "No deterministic canonicalizer is configured for "),
    "mr": ("non_decisive", None, None, "maturity_duration_without_reference",
           "Maturity duration does not explicitly reference inception date."),
    "mf": ("non_decisive", None, None, "maturity_derivation_failed",
           "Maturity derivation requires decisive inception date and duration."),
    "md": ("decisive", "date", "derived_from_inception", "maturity_derived_from_inception",
           "Maturity date derived from same-side inception date."),
}
DECISIVE_CODES = [c for c, v in OUTCOMES.items() if v[0] == "decisive"]


# Expressions over columns of fixed names are built once a process (``lru_cache``): building them, call by call
# into the JVM, took longer than planning the query.


def _code(probe: Column) -> Column:
    return F.substring(probe, 1, 2)


def _rest(probe: Column) -> Column:
    return F.substr(probe, F.lit(3))


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


# --- probes -----------------------------------------------------------------------------


def percent_probe(raw: Column) -> Column:
    """``P:<percent>|<permille>|<basis points>|<bare number>`` with at most one part filled."""
    return F.concat(F.lit("P:"), F.regexp_replace(raw, PERCENT_LADDER, "$1|$2|$3|$4"))


def date_probe(raw: Column) -> Column:
    """``D:<absolute>|<Korean>`` with at most one part filled."""
    return F.concat(F.lit("D:"), F.regexp_replace(raw, DATE_LADDER, "$1$2$3|$4"))


def _sum_matches(raw: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
    return F.aggregate(
        found, F.lit(0).cast("bigint"), lambda acc, x: F.try_add(acc, x.try_cast("bigint"))
    )


def months_in(raw: Column) -> Column:
    """Total months named by the text; null when the figures overflow."""
    return F.try_add(
        F.try_multiply(_sum_matches(raw, YEARS), F.lit(12).cast("bigint")), _sum_matches(raw, MONTHS)
    )


def duration_probe(raw: Column) -> Column:
    return F.concat(F.lit("M:"), F.coalesce(months_in(raw).cast("string"), F.lit("0")))


def boolean_probe(raw: Column) -> Column:
    compact = F.regexp_replace(raw, rf"(?U){WS}+", "")
    return (
        F.when(_any_word(compact, NEGATIVE_WORDS), F.lit("bffalse"))
        .when(_any_word(compact, POSITIVE_WORDS), F.lit("bttrue"))
        .otherwise(F.lit("bx"))
    )


def absence_probe(raw: Column, semantics: Column) -> Column:
    """Missing or absent evidence; null when the text should be parsed."""
    compact = F.replace(raw, F.lit(" "), F.lit(""))
    return (
        F.when(raw.isNull(), F.lit("m0"))
        .when(is_blank(raw), F.lit("m1"))
        .when(
            _any_word(compact, ABSENCE_WORDS),
            F.when(semantics == "zero_value", F.lit("az0")).otherwise(F.lit("am")),
        )
    )


def maturity_probe(raw: Column) -> Column:
    """Absolute date of a maturity text (null evidence is missing, blank is unparseable)."""
    return F.when(raw.isNull(), F.lit("m0")).otherwise(date_probe(raw))


def months_from_reference(raw: Column) -> Column:
    """Months named by a text that counts from inception; null when it does not refer to it."""
    compact = F.replace(raw, F.lit(" "), F.lit(""))
    return F.when(
        _any_word(compact, REFERENCE_WORDS), F.coalesce(months_in(raw).cast("string"), F.lit("0"))
    )


def value_probe(raw: Column, canonicalizer: Column, semantics: Column) -> Column:
    """Dispatch on the field's canonicalizer; only the chosen branch is evaluated."""
    return F.coalesce(
        absence_probe(raw, semantics),
        F.when(canonicalizer == "percent", percent_probe(raw))
        .when(canonicalizer == "date", date_probe(raw))
        .when(canonicalizer == "duration", duration_probe(raw))
        .when(canonicalizer == "boolean", boolean_probe(raw))
        .otherwise(F.lit("nc")),
    )


# --- settling ---------------------------------------------------------------------------


def strip_zeros(number: Column) -> Column:
    """Plain decimal text without trailing zeros (``0.8900`` -> ``0.89``, ``10`` -> ``10``)."""
    return F.regexp_replace(F.regexp_replace(number, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def shift_left(number: Column, places: int) -> Column:
    """Divide decimal text by 10**places exactly, then drop needless zeros."""
    moved = F.regexp_replace(
        F.concat(F.lit("0" * places), number), rf"^([0-9]+)([0-9]{{{places}}})(?:\.([0-9]*))?$", "$1.$2$3")
    return F.regexp_replace(moved, r"^0+(?=[0-9])|\.?0+$", "")


def date_text(match: Column) -> Column:
    """ISO text of a matched date expression; null when it is not a calendar date."""
    # Folding walks through hundreds of digits; text of ASCII and the three units has none to fold.
    folded = F.when(match.rlike(r"[^\x00-\x7f년월일]"), fold_digits(match)).otherwise(match)
    parts = F.rtrim(F.regexp_replace(folded, r"[^0-9]+", "-"), F.lit("-"))
    # Year 0 exists in Spark's calendar only.
    return F.regexp_replace(parts, "^0000", "x").try_cast("date").cast("string")


def _slot(probe: Column, index: int) -> Column:
    """index-th ``|``-separated slot (byte search, no regular expression)."""
    head = F.substring_index(probe, "|", index)
    return head if index == 1 else F.substring_index(head, "|", -1)


def _part(probe: Column, index: int) -> Column:
    return _slot(_rest(probe), index)


def _dated(code: str, match: Column) -> Column:
    return F.coalesce(F.concat(F.lit(code), date_text(match)), F.lit("di"))


def _settle_percent(probe: Column) -> Column:
    return (
        F.when(_part(probe, 1) != "", F.concat(F.lit("pc"), _part(probe, 1)))
        .when(_part(probe, 2) != "", F.concat(F.lit("pm"), shift_left(_part(probe, 2), 1)))
        .when(_part(probe, 3) != "", F.concat(F.lit("bp"), shift_left(_part(probe, 3), 2)))
        .when(_part(probe, 4) != "", F.lit("pu"))
        .otherwise(F.lit("px"))
    )


def _settle_date(probe: Column) -> Column:
    return (
        F.when(_part(probe, 1) != "", _dated("da", _part(probe, 1)))
        .when(_part(probe, 2) != "", _dated("dk", _part(probe, 2)))
        .otherwise(F.lit("dx"))
    )


def _settle_duration(probe: Column) -> Column:
    return F.when(_rest(probe).cast("bigint") > 0, F.concat(F.lit("du"), _rest(probe))).otherwise(F.lit("dn"))


# Probe family -> how it is settled, and the canonicalizers whose probes are of a family.
SETTLERS = {"P:": _settle_percent, "D:": _settle_date, "M:": _settle_duration}
FAMILIES = {"percent": "P:", "date": "D:", "maturity_date": "D:", "duration": "M:"}


def families(canonicalizers) -> tuple[str, ...]:
    """The families of probes that these canonicalizers make; other probes are outcomes already."""
    return tuple(sorted({FAMILIES[c] for c in canonicalizers if c in FAMILIES}))


def settle(probe: Column, kinds: tuple[str, ...] = tuple(SETTLERS)) -> Column:
    """Outcome code and value of a probe, as one text. ``kinds``: the families that can occur."""
    out = probe
    for kind in reversed(kinds):
        out = F.when(_code(probe) == kind, SETTLERS[kind](probe)).otherwise(out)
    return out


@lru_cache(maxsize=64)
def settled(name: str, kinds: tuple[str, ...] = tuple(SETTLERS)) -> Column:
    """``settle`` of a column, built once: every function call of an expression is a call into the JVM."""
    return settle(F.col(name), kinds)


def add_months_text(start: Column, months: Column) -> Column:
    """ISO date plus months, clamped to the month end; null past year 9999."""
    moved = F.add_months(start.cast("date"), months.try_cast("int"))
    return F.when(F.year(moved) <= 9999, moved.cast("string"))


def settle_maturity(direct: Column, months: Column, inception: Column) -> Column:
    """Combine a settled direct date, months-from-inception and a settled inception date."""
    usable = code_of(inception).isin("da", "dk") & (months.cast("bigint") > 0)
    derived = F.when(usable, F.concat(F.lit("md"), add_months_text(_rest(inception), months)))
    return (
        F.when(code_of(direct).isin("da", "dk", "m0"), direct)
        .when(months.isNull(), F.lit("mr"))
        .otherwise(F.coalesce(derived, F.lit("mf")))
    )


def code_of(settled: Column) -> Column:
    return _code(settled)


def value_of(settled: Column) -> Column:
    return F.when(F.length(settled) > 2, _rest(settled))


def is_decisive(settled: Column) -> Column:
    return code_of(settled).isin(*DECISIVE_CODES)


def _lookup(code: Column, index: int) -> Column:
    return lookup(code, {c: v[index] for c, v in OUTCOMES.items() if v[index] is not None})


def unit_of(settled: Column, value_type: Column) -> Column:
    code = code_of(settled)
    return F.when(code == "az", value_type).otherwise(_lookup(code, 1))


def describe(settled: Column, value_type: Column, field: Column, metadata: Column | None = None) -> Column:
    """The full canonical value: status, value, unit, method, reason and metadata."""
    code = code_of(settled)
    reason = F.when(code == "nc", F.concat(F.lit(OUTCOMES["nc"][4]), field, F.lit("."))).otherwise(
        _lookup(code, 4)
    )
    empty = F.create_map().cast("map<string,string>")
    return F.struct(
        _lookup(code, 0).alias("status"), value_of(settled).alias("value"),
        unit_of(settled, value_type).alias("unit"), _lookup(code, 2).alias("method"),
        _lookup(code, 3).alias("reason_code"), reason.alias("reason"),
        (empty if metadata is None else F.coalesce(metadata, empty)).alias("metadata"),
    )


# --- scalar parsers -----------------------------------------------------------------------

PROBES = {"percent": percent_probe, "date": date_probe, "duration": duration_probe, "boolean": boolean_probe}


def parse(df: DataFrame, kind: str, raw: str, out: str) -> DataFrame:
    """Add the canonical value of one text column: probe, settle and describe in three projections."""
    text = F.col(raw)
    probe = F.when(text.isNull() | is_blank(text), F.lit("m0")).otherwise(PROBES[kind](text))
    staged = df.withColumn(f"_{out}_p", probe)
    staged = staged.withColumn(f"_{out}_s", settle(F.col(f"_{out}_p")))
    value_type = {"percent": "percent_per_year"}.get(kind, kind)
    return staged.withColumn(out, describe(F.col(f"_{out}_s"), F.lit(value_type), F.lit(""))).drop(
        f"_{out}_p", f"_{out}_s")


# --- the guards' own dialects ---------------------------------------------------------------


def guard_percent_probe(raw: Column) -> Column:
    """``<percent>|<permille>``: basis points and ``천분의`` stay unrecognised."""
    return F.regexp_replace(raw, GUARD_PERCENT_LADDER, "$1|$2")


def guard_percent_value(probe: Column) -> Column:
    percent, permille = _slot(probe, 1), _slot(probe, 2)
    # Never cast the empty slot: a failing cast costs an exception per row.
    return F.when(percent != "", percent.cast("double")).when(
        permille != "", permille.cast("double") / F.lit(10.0))


def guard_date_probe(raw: Column) -> Column:
    """``<ISO or slash date in the first ten characters>|<Korean date anywhere>``."""
    return F.regexp_replace(raw, GUARD_DATE_PARTS, "$1$3|$5")


def guard_date_value(probe: Column) -> Column:
    head, korean = _slot(probe, 1), _slot(probe, 2)
    return F.coalesce(F.when(head != "", date_text(head)), F.when(korean != "", date_text(korean)))


def shape_percent(raw: Column) -> Column:
    """The constraint rules' percent: last ``1,000분의`` figure / 10, else first figure before %."""
    permille = r"1[,，]?000\s*분의"
    one_line = ~raw.contains("\n")
    by_mille = F.regexp_extract(raw, r"^.*1[,，]?000\s*분의\s*([0-9]+(?:\.[0-9]+)?).*$", 1)
    by_cent = F.regexp_extract(raw, r"^.*?([0-9]+(?:\.[0-9]+)?)[^0-9.]*%.*$", 1)
    number = "decimal(38,10)"
    return F.when(
        one_line,
        F.when(raw.rlike(permille), F.nullif(by_mille, F.lit("")).try_cast(number) / F.lit(10)).when(
            raw.contains("%"), F.nullif(by_cent, F.lit("")).try_cast(number)
        ),
    ).cast("double")
