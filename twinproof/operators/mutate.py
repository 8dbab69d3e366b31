"""Labelled test cases by mutation: the contract side stays, the memo side is changed.

Which mutation a case gets is a function of its key alone, so the set is reproducible
whatever the partitioning. Input: ``case_key, field, family, anchor, anchor_page``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions import canonical as C
from twinproof.functions.canonical import date_text, shift_left
from twinproof.functions.literals import lookup
from twinproof.operators.compare import compare_values, with_policy
from twinproof.profile import TRUST_FUND, Profile
from twinproof.session import late_filter

# Mutations per value family; the key's hash picks one. "x/y" is mutation x in flavour y.
FAMILIES = {
    "percent": ("unit_conversion/percent", "unit_conversion/bp", "format_diff", "whitespace_normalize",
                "decimal_shift", "digit_swap", "shacl_violation", "fake_citation", "missing_one_side",
                "invent_clause"),
    "date": ("format_diff/-", "format_diff/.", "format_diff//", "whitespace_normalize", "date_shift/year",
             "date_shift/week", "fake_citation", "missing_one_side"),
    "name": ("whitespace_normalize", "format_diff", "char_typo", "entity_swap", "digit_insert",
             "fake_citation", "missing_one_side", "identical"),
    "boolean": ("semantic_equivalent", "bool_flip", "whitespace_normalize", "fake_citation",
                "missing_one_side", "invent_clause"),
    "duration": ("unit_conversion", "date_shift", "whitespace_normalize", "fake_citation", "missing_both"),
}

# Mutation -> (difficulty, signal expected to catch it).
TRAITS = {
    "unit_conversion": ("hard", "normalization"), "format_diff": ("easy", "normalization"),
    "whitespace_normalize": ("easy", "normalization"), "semantic_equivalent": ("medium", "llm_judge"),
    "identical": ("easy", "cross_check"), "missing_one_side": ("easy", "cross_check"),
    "missing_both": ("easy", "cross_check"), "decimal_shift": ("hard", "normalization+cross_check"),
    "digit_swap": ("medium", "cross_check"), "date_shift": ("medium", "cross_check"),
    "char_typo": ("hard", "cross_check+llm_judge"), "entity_swap": ("medium", "cross_check"),
    "digit_insert": ("hard", "cross_check"), "bool_flip": ("medium", "llm_judge"),
    "invent_clause": ("hard", "cross_check+llm_judge"), "fake_citation": ("hard", "g2_citation"),
    "shacl_violation": ("hard", "g3_constraint+shacl"),
}
FAKE_PAGE = 999
OTHER_ENTITY = "다온미래 주식회사"


def key_hash(key: Column) -> Column:
    """Portable 32-bit hash of a key: the first eight hex digits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def swap_last_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"([0-9])(\.?)([0-9])([^0-9]*)$", "$3$2$1$4")


def shift_decimal(text: Column) -> Column:
    return F.regexp_replace(text, r"([0-9]+)\.([0-9]+)([^0-9]*)$", "0.$1$2$3")


def double_last_digit(text: Column) -> Column:
    return F.regexp_replace(text, r"([0-9])([^0-9]*)$", "$1$1$2")


def replace_third(text: Column) -> Column:
    return F.concat(F.substring(text, 1, 2), F.lit("뷁"), F.substr(text, F.lit(4)))


def widen_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("　 "))


def _percent(anchor: Column) -> Column:
    """Percent text of a permille anchor; zero for an absence."""
    found = F.regexp_replace(anchor, rf"(?sU)^(?:.*?{C.PERMILLE}|).*", "$1")
    return F.when(found == "", F.lit("0")).otherwise(shift_left(found, 1))


def _basis_points(percent: Column) -> Column:
    return C.strip_zeros((percent.cast("decimal(20,6)") * F.lit(100).cast("decimal(3,0)")).cast("string"))


def _korean(iso: Column) -> Column:
    d = iso.cast("date")
    return F.concat(F.year(d).cast("string"), F.lit("년 "), F.month(d).cast("string"), F.lit("월 "),
                    F.dayofmonth(d).cast("string"), F.lit("일"))


def mutate(df: DataFrame) -> DataFrame:
    """Add both sides, the gold label, mutation, difficulty and signal to anchored cases."""
    code = F.lit(None).cast("string")
    for family, kinds in FAMILIES.items():
        names = F.array(*[F.lit(k) for k in kinds])
        code = F.when(F.col("family") == family, names[F.pmod(key_hash(F.col("case_key")), F.lit(len(kinds))).cast("int")]
                      ).otherwise(code)
    anchor = F.col("anchor")
    staged = df.withColumn("_kind", code).withColumns({
        "_pct": F.when(F.col("family") == "percent", _percent(anchor)),
        "_iso": F.when(F.col("family") == "date", date_text(F.regexp_extract(anchor, "(?U)" + C.DATE_KOREAN, 0))),
        "_months": F.when(F.col("family") == "duration", C.months_in(anchor)),
    })
    kind, family = F.col("_kind"), F.col("family")
    pct, iso, months = F.col("_pct"), F.col("_iso"), F.col("_months")
    years = F.floor(months / 12).cast("string")
    rest = (months % 12).cast("string")
    im = (
        F.when(kind == "unit_conversion/percent", F.concat(F.lit("연[ "), pct, F.lit(" ] %")))
        .when(kind == "unit_conversion/bp", F.concat(F.lit("연 "), _basis_points(pct), F.lit("bp")))
        .when(kind == "shacl_violation", F.concat(F.lit("연[ "), F.regexp_replace(pct, r"^[0-9]+", "9"), F.lit(" ] %")))
        .when((kind == "format_diff") & (family == "percent"), F.replace(anchor, F.lit("1,000"), F.lit("1000")))
        .when(kind == "format_diff/-", F.concat(F.lit("예정 "), iso))
        .when(kind == "format_diff/.", F.concat(F.lit("예정 "), F.translate(iso, "-", ".")))
        .when(kind == "format_diff//", F.concat(F.lit("예정 "), F.translate(iso, "-", "/")))
        .when(kind == "date_shift/year", _korean(F.add_months(iso.cast("date"), 12)))
        .when(kind == "date_shift/week", _korean(F.date_add(iso.cast("date"), 7)))
        .when(kind == "format_diff", F.concat(F.lit("(주)"), anchor))
        .when(kind == "whitespace_normalize", widen_spaces(anchor))
        .when(kind == "decimal_shift", shift_decimal(anchor))
        .when(kind == "digit_swap", swap_last_digits(anchor))
        .when(kind == "char_typo", replace_third(anchor))
        .when(kind == "entity_swap", F.lit(OTHER_ENTITY))
        .when(kind == "digit_insert", double_last_digit(anchor))
        .when(kind == "semantic_equivalent", F.when(anchor.contains("불가"), F.lit("중도환매가 제한됩니다."))
              .otherwise(F.lit("중도환매가 허용됩니다.")))
        .when(kind == "bool_flip", F.when(anchor.contains("불가"), F.lit("환매 가능")).otherwise(F.lit("환매 불가")))
        .when((kind == "unit_conversion") & (family == "duration"), F.concat(years, F.lit("년 "), rest, F.lit("개월")))
        .when((kind == "date_shift") & (family == "duration"), F.concat((months + 1).cast("string"), F.lit("개월")))
        .when(kind.isin("missing_one_side", "missing_both"), F.lit(None).cast("string"))
        .otherwise(anchor)
    )
    mutation = F.substring_index("_kind", "/", 1)
    one_sided = mutation.isin("invent_clause", "missing_both")
    staged = staged.withColumns({
        "mutation_type": mutation,
        "contract_raw": F.when(~one_sided, anchor),
        "contract_page": F.when(~one_sided, F.col("anchor_page")),
        "im_raw": im,
    })
    gold = (
        F.when(F.col("mutation_type").isin("missing_one_side", "missing_both"), F.lit("missing"))
        .when(F.col("mutation_type").isin("invent_clause", "fake_citation"), F.lit("mismatch"))
        .when(F.col("im_raw").eqNullSafe(anchor), F.lit("match"))
        .when(F.col("mutation_type").isin("unit_conversion", "format_diff", "whitespace_normalize",
                                          "semantic_equivalent"), F.lit("match"))
        .otherwise(F.lit("mismatch"))
    )
    trait = lambda i: lookup(F.col("mutation_type"), {k: v[i] for k, v in TRAITS.items()})
    return staged.select(
        F.col("case_key").alias("case_id"), "field", gold.alias("gold_label"), "mutation_type",
        trait(0).alias("difficulty"), trait(1).alias("harness_signal"), "contract_raw",
        F.col("contract_page").cast("int").alias("contract_page"), "im_raw",
        F.when(F.col("im_raw").isNotNull(), F.when(F.col("mutation_type") == "fake_citation", F.lit(FAKE_PAGE))
               .otherwise(F.lit(9))).alias("im_page"),
        F.when(gold == "mismatch", F.lit("변조")).otherwise(F.lit("정상")).alias("category"),
    )


def label_contradictions(cases: DataFrame, inception: str, target: str, profile: Profile = TRUST_FUND) -> DataFrame:
    """Cases whose gold label the deterministic rules contradict.

    ``inception`` and ``target`` are the reference dates of maturity cases: the memo's date, or
    inception plus its duration, must equal ``target`` exactly for matches.
    """
    rows = with_policy(cases, profile)
    mutation, gold = F.col("mutation_type"), F.col("gold_label")
    is_maturity = F.col("canonicalizer") == "maturity_date"
    rows = rows.withColumns({
        "_ip": F.when(mutation == "shacl_violation", C.percent_probe(F.col("im_raw"))),
        "_dp": F.when(is_maturity, F.coalesce(C.absence_probe(F.col("im_raw"), F.lit("")), C.date_probe(F.col("im_raw")))),
        "_mm": F.when(is_maturity, C.months_in(F.col("im_raw"))),
    })
    rows = compare_values(rows.withColumns({"_ipv": C.settle(F.col("_ip")), "_dpv": C.settle(F.col("_dp"))}))
    value = C.value_of(F.col("_ipv")).try_cast("double")
    reached = F.when(C.code_of(F.col("_dpv")).isin("da", "dk"), C.value_of(F.col("_dpv"))).otherwise(
        F.when(F.col("_mm") > 0, C.add_months_text(F.lit(inception), F.col("_mm").cast("string"))))
    problem = (
        F.when(mutation == "fake_citation",
               F.when(~(F.coalesce(F.col("im_page"), F.lit(0)) >= 900), F.lit("fake_citation_page")))
        .when(mutation == "shacl_violation",
              F.when(value.isNull(), F.lit("range_case_unparseable"))
              .when(F.col("range_min").isNull() | value.between(F.col("range_min"), F.col("range_max")),
                    F.lit("range_case_inside_range")))
        .when(is_maturity,
              F.when(reached.isNull(), F.lit("maturity_unparseable"))
              .when((gold == "match") & (reached != target), F.lit("match_but_different"))
              .when((gold == "mismatch") & (reached == target), F.lit("mismatch_but_same")))
        .when((gold == "match") & (F.col("_verdict") == "different_after_normalization"), F.lit("match_but_different"))
        .when((gold == "mismatch") & (F.col("_verdict") == "same_after_normalization"), F.lit("mismatch_but_same"))
    )
    return late_filter(rows.withColumn("problem", problem), F.col("problem").isNotNull()).select(
        "case_id", "field", "gold_label", "mutation_type", "problem")


def append_cases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add cases whose id is new; existing rows always stay."""
    fresh = new.join(existing.select("case_id").distinct(), "case_id", "left_anti")
    return existing.unionByName(fresh)


def ordered_cases(cases: DataFrame) -> DataFrame:
    """Report order: the number inside the case id."""
    return cases.orderBy(F.regexp_extract("case_id", r"([0-9]+)", 1).try_cast("bigint"), "case_id")
