"""ANSI SQL restatements used by the correctness gate (DuckDB runs them on the same tables)."""

from __future__ import annotations

from twinproof.functions import verdicts as V
from twinproof.plans import workload as L
from twinproof.profile import SIDES, TRUST_FUND

# Stated again on purpose, not imported: a wrong table under test must not be wrong here too.
FAMILIES = {
    "percent": ("unit_conversion/percent", "unit_conversion/bp", "format_diff", "whitespace_normalize", "decimal_shift",
                "digit_swap", "shacl_violation", "fake_citation", "missing_one_side", "invent_clause"),
    "date": ("format_diff/-", "format_diff/.", "format_diff//", "whitespace_normalize", "date_shift/year", "date_shift/week",
             "fake_citation", "missing_one_side"),
    "name": ("whitespace_normalize", "format_diff", "char_typo", "entity_swap", "digit_insert", "fake_citation",
             "missing_one_side", "identical"),
    "boolean": ("semantic_equivalent", "bool_flip", "whitespace_normalize", "fake_citation", "missing_one_side", "invent_clause"),
    "duration": ("unit_conversion", "date_shift", "whitespace_normalize", "fake_citation", "missing_both"),
}
DIFFICULTY = {
    "easy": ("format_diff", "whitespace_normalize", "identical", "missing_one_side", "missing_both"),
    "medium": ("semantic_equivalent", "digit_swap", "date_shift", "entity_swap", "bool_flip"),
    "hard": ("unit_conversion", "decimal_shift", "char_typo", "digit_insert", "invent_clause", "fake_citation", "shacl_violation"),
}
SIGNAL = {
    "normalization": ("unit_conversion", "format_diff", "whitespace_normalize"),
    "llm_judge": ("semantic_equivalent", "bool_flip"),
    "cross_check": ("identical", "missing_one_side", "missing_both", "digit_swap", "date_shift", "entity_swap", "digit_insert"),
    "normalization+cross_check": ("decimal_shift",),
    "cross_check+llm_judge": ("char_typo", "invent_clause"),
    "g2_citation": ("fake_citation",),
    "g3_constraint+shacl": ("shacl_violation",),
}
FAKE_PAGE, OTHER_ENTITY = 999, "다온미래 주식회사"

WS = r"[\s\x{3000}]"
NUM = r"([0-9]+(?:\.[0-9]+)?)"


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, other: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {other} END"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def policy_cte() -> str:
    rows = ", ".join(
        "(" + ", ".join(q(v) for v in (p.field, i, p.label, p.value_type, p.canonicalizer, p.compare_policy,
                                       p.judge_allowed, p.absence_semantics)) +
        f", CAST({q(p.range_min)} AS DOUBLE), CAST({q(p.range_max)} AS DOUBLE))"
        for i, p in enumerate(TRUST_FUND.policies))
    return ("policy(field, pord, label, value_type, canonicalizer, compare_policy, judge_allowed, "
            f"absence_semantics, range_min, range_max) AS (VALUES {rows})")


# --- scalar fragments --------------------------------------------------------------------------


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def blank(x: str) -> str:
    return f"(regexp_replace({x}, '{WS}+', '', 'g') = '')"


def strip_zeros(t: str) -> str:
    return f"(CASE WHEN contains({t}, '.') THEN regexp_replace({t}, '\\.?0+$', '') ELSE {t} END)"


def percent_match(x: str) -> str:
    return f"nullif(regexp_extract(translate({x}, '[]()', '    '), '{NUM}{WS}*%', 1), '')"


def permille_match(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?:1[,，]?000|1000|1{WS}*천){WS}*분의{WS}*{NUM}', 1), '')"


def guard_permille_match(x: str) -> str:
    return f"nullif(regexp_extract({x}, '1[,，]?000{WS}*분의{WS}*{NUM}', 1), '')"


def bp_match(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?i){NUM}{WS}*(?:bps?|basis{WS}*points?)', 1), '')"


def scaled(x: str, factor: str) -> str:
    return strip_zeros(f"CAST(CAST({x} AS DECIMAL(18, 6)) * CAST({factor} AS DECIMAL(3, 2)) AS VARCHAR)")


def percent_value(x: str) -> str:
    return (f"coalesce({percent_match(x)}, {scaled(permille_match(x), '0.10')}, {scaled(bp_match(x), '0.01')})")


def percent_reason(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {blank(x)} THEN 'missing_raw_text' WHEN {percent_match(x)} IS NOT NULL THEN 'percent_unit' "
            f"WHEN {permille_match(x)} IS NOT NULL THEN 'permille_unit' WHEN {bp_match(x)} IS NOT NULL THEN 'basis_point_unit' "
            f"WHEN regexp_full_match({x}, '{WS}*[0-9]+(?:\\.[0-9]+)?{WS}*') THEN 'percent_unit_missing' "
            "ELSE 'percent_unparseable' END")


def date_match(x: str) -> str:
    parts = [f"nullif(regexp_extract({x}, '\\d{{4}}{sep}\\d{{1,2}}{sep}\\d{{1,2}}', 0), '')" for sep in ("-", r"\.", "/")]
    parts.append(f"nullif(regexp_extract({x}, '\\d{{4}}{WS}*년{WS}*\\d{{1,2}}{WS}*월{WS}*\\d{{1,2}}{WS}*일', 0), '')")
    return f"coalesce({', '.join(parts)})"


def as_date(match: str) -> str:
    return f"CAST(try_strptime(regexp_replace(regexp_replace({match}, '[^0-9]+', '-', 'g'), '-$', ''), '%Y-%m-%d') AS DATE)"


def date_value(x: str) -> str:
    return f"CAST({as_date(date_match(x))} AS VARCHAR)"


def date_reason(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {blank(x)} THEN 'missing_raw_text' WHEN {date_match(x)} IS NULL THEN 'date_unparseable' "
            f"WHEN {as_date(date_match(x))} IS NULL THEN 'date_invalid' ELSE 'date_parsed' END")


def months(x: str) -> str:
    total = lambda unit: (
        f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '([0-9]+){WS}*{unit}', 1), lambda v: CAST(v AS BIGINT))), 0)")
    return f"CAST({total('년')} * 12 + {total('개월')} AS BIGINT)"


def duration_value(x: str) -> str:
    return f"CASE WHEN {months(x)} > 0 THEN CAST({months(x)} AS VARCHAR) END"


def boolean_value(x: str) -> str:
    c = f"regexp_replace({x}, '{WS}+', '', 'g')"
    return (f"CASE WHEN regexp_matches({c}, '불가|없음|아니|제한') THEN 'false' "
            f"WHEN regexp_matches({c}, '가능|허용|할수있') THEN 'true' END")


def absent(x: str) -> str:
    return f"regexp_matches(replace({x}, ' ', ''), '없음|부과하지아니함|면제')"


def value_sql(x: str) -> str:
    """Canonical value or NULL, for the policy columns in scope (no derivation)."""
    return (f"CASE WHEN {x} IS NULL OR {blank(x)} THEN NULL "
            f"WHEN {absent(x)} THEN CASE WHEN absence_semantics = 'zero_value' THEN '0' END "
            f"WHEN canonicalizer = 'percent' THEN {percent_value(x)} WHEN canonicalizer = 'date' THEN {date_value(x)} "
            f"WHEN canonicalizer = 'duration' THEN {duration_value(x)} WHEN canonicalizer = 'boolean' THEN {boolean_value(x)} END")


def maturity_sql(x: str, ref: str) -> str:
    inception = as_date(date_match(ref))
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {as_date(date_match(x))} IS NOT NULL THEN {date_value(x)} "
            f"WHEN contains(replace({x}, ' ', ''), '설정일') AND {inception} IS NOT NULL AND {months(x)} > 0 "
            f"THEN CAST(CAST({inception} + to_months(CAST({months(x)} AS INT)) AS DATE) AS VARCHAR) END")


def guard_percent(x: str) -> str:
    return f"coalesce(CAST({percent_match(x)} AS DOUBLE), CAST({guard_permille_match(x)} AS DOUBLE) / 10)"


def guard_date(x: str) -> str:
    head = f"substr(trim({x}), 1, 10)"
    kor = f"nullif(regexp_extract({x}, '\\d{{4}}{WS}*년{WS}*\\d{{1,2}}{WS}*월{WS}*\\d{{1,2}}{WS}*일', 0), '')"
    iso = lambda sep: f"CASE WHEN regexp_full_match({head}, '\\d{{4}}{sep}\\d{{1,2}}{sep}\\d{{1,2}}') THEN {as_date(head)} END"
    return f"coalesce({iso('-')}, {iso('/')}, {as_date(kor)})"


# --- relations -----------------------------------------------------------------------------------


def _mod(n: int) -> str:
    return f"(('0x' || substr(md5(case_key), 1, 8))::BIGINT % {n})"


def cases_cte(tables: tuple[str, ...] = tuple(L.ANCHORS)) -> str:
    """CTE chain ending in ``cases``: the mutation rules as one CASE per column."""
    kinds = "CASE family " + " ".join(
        f"WHEN {q(f)} THEN list_extract({'[' + ', '.join(q(k) for k in ks) + ']'}, 1 + {_mod(len(ks))})"
        for f, ks in FAMILIES.items()) + " END"
    pct = f"coalesce({scaled(permille_match('anchor'), '0.10')}, '0')"
    kor = lambda d: f"year({d}) || '년 ' || month({d}) || '월 ' || day({d}) || '일'"
    im = (
        "CASE WHEN kind = 'unit_conversion/percent' THEN '연[ ' || pct || ' ] %' "
        f"WHEN kind = 'unit_conversion/bp' THEN '연 ' || {strip_zeros('CAST(CAST(pct AS DECIMAL(18,6)) * 100 AS VARCHAR)')} || 'bp' "
        "WHEN kind = 'shacl_violation' THEN '연[ ' || regexp_replace(pct, '^[0-9]+', '9') || ' ] %' "
        "WHEN kind = 'format_diff' AND family = 'percent' THEN replace(anchor, '1,000', '1000') "
        "WHEN kind = 'format_diff/-' THEN '예정 ' || iso WHEN kind = 'format_diff/.' THEN '예정 ' || replace(CAST(iso AS VARCHAR), '-', '.') "
        "WHEN kind = 'format_diff//' THEN '예정 ' || replace(CAST(iso AS VARCHAR), '-', '/') "
        f"WHEN kind = 'date_shift/year' THEN {kor('CAST(iso + to_months(12) AS DATE)')} "
        f"WHEN kind = 'date_shift/week' THEN {kor('CAST(iso + to_days(7) AS DATE)')} "
        "WHEN kind = 'format_diff' THEN '(주)' || anchor WHEN kind = 'whitespace_normalize' THEN replace(anchor, ' ', '　 ') "
        r"WHEN kind = 'decimal_shift' THEN regexp_replace(anchor, '([0-9]+)\.([0-9]+)([^0-9]*)$', '0.\1\2\3') "
        r"WHEN kind = 'digit_swap' THEN regexp_replace(anchor, '([0-9])(\.?)([0-9])([^0-9]*)$', '\3\2\1\4') "
        "WHEN kind = 'char_typo' THEN substr(anchor, 1, 2) || '뷁' || substr(anchor, 4) "
        f"WHEN kind = 'entity_swap' THEN {q(OTHER_ENTITY)} "
        r"WHEN kind = 'digit_insert' THEN regexp_replace(anchor, '([0-9])([^0-9]*)$', '\1\1\2') "
        "WHEN kind = 'semantic_equivalent' THEN CASE WHEN contains(anchor, '불가') THEN '중도환매가 제한됩니다.' ELSE '중도환매가 허용됩니다.' END "
        "WHEN kind = 'bool_flip' THEN CASE WHEN contains(anchor, '불가') THEN '환매 가능' ELSE '환매 불가' END "
        "WHEN kind = 'unit_conversion' THEN (mon // 12) || '년 ' || (mon % 12) || '개월' "
        "WHEN kind = 'date_shift' THEN (mon + 1) || '개월' "
        "WHEN kind IN ('missing_one_side', 'missing_both') THEN NULL ELSE anchor END")
    traits = lambda i: case_map("mutation_type", {k: name for name, ks in (DIFFICULTY, SIGNAL)[i].items() for k in ks})
    return (
        f"anchors AS ({L.anchors_sql(tables)}), "
        f"kinded AS (SELECT *, {kinds} AS kind, {pct} AS pct, CASE WHEN family = 'date' THEN {as_date(date_match('anchor'))} END AS iso, "
        f"{months('anchor')} AS mon FROM anchors), "
        f"mutated AS (SELECT *, split_part(kind, '/', 1) AS mutation_type, {im} AS im_raw FROM kinded), "
        "golden AS (SELECT *, CASE WHEN mutation_type IN ('missing_one_side', 'missing_both') THEN 'missing' "
        "WHEN mutation_type IN ('invent_clause', 'fake_citation') THEN 'mismatch' WHEN im_raw IS NOT DISTINCT FROM anchor THEN 'match' "
        "WHEN mutation_type IN ('unit_conversion', 'format_diff', 'whitespace_normalize', 'semantic_equivalent') THEN 'match' "
        "ELSE 'mismatch' END AS gold_label FROM mutated), "
        f"cases AS (SELECT case_key AS case_id, field, gold_label, mutation_type, {traits(0)} AS difficulty, {traits(1)} AS harness_signal, "
        "CASE WHEN mutation_type NOT IN ('invent_clause', 'missing_both') THEN anchor END AS contract_raw, "
        "CASE WHEN mutation_type NOT IN ('invent_clause', 'missing_both') THEN anchor_page END AS contract_page, im_raw, "
        f"CASE WHEN im_raw IS NOT NULL THEN CASE WHEN mutation_type = 'fake_citation' THEN {FAKE_PAGE} ELSE 9 END END AS im_page, "
        "CASE WHEN gold_label = 'mismatch' THEN '변조' ELSE '정상' END AS category FROM golden)")


def case_evidence_cte(tables: tuple[str, ...] = tuple(L.ANCHORS)) -> str:
    """``cases`` as evidence rows ``ev`` (pages of absent cells dropped, no reference cells)."""
    cells = ", ".join(
        f"CASE WHEN {s}_raw IS NOT NULL THEN CASE WHEN {s}_page > 0 THEN {s}_page ELSE 1 END END AS {s}_page, "
        f"CASE WHEN {s}_raw IS NOT NULL THEN {q(TRUST_FUND.documents[s])} END AS {s}_doc, "
        f"CAST(NULL AS VARCHAR) AS {s}_ref_raw, CAST(NULL AS INT) AS {s}_ref_page, CAST(NULL AS VARCHAR) AS {s}_ref_doc"
        for s in SIDES)
    return (f"{cases_cte(tables)}, ev AS (SELECT case_id, field, gold_label, mutation_type, difficulty, harness_signal, "
            f"contract_raw, im_raw, {cells}, {L.CONTRACT_PAGES} AS contract_pages, {L.IM_PAGES} AS im_pages FROM cases)")


_BAD2 = "('page_out_of_range', 'citation_document_mismatch')"


def guard_cte(citation: bool = True, constraint: bool = True) -> str:
    """CTE chain from ``ev`` to ``guarded``: codes g2_*, g3a_*, g3c_*, emptied cells, ``caught``."""

    def code(s: str, p: str) -> str:
        if not citation:
            return "CAST(NULL AS VARCHAR)"
        return (f"CASE WHEN {p}_page IS NULL THEN NULL WHEN {p}_page < 1 OR {p}_page > {s}_pages THEN 'page_out_of_range' "
                f"WHEN {p}_doc IS DISTINCT FROM {q(TRUST_FUND.documents[s])} THEN 'citation_document_mismatch' ELSE 'page_in_range' END")

    g2 = ", ".join(f"{code(s, s)} AS g2_{s}, {code(s, s + '_ref')} AS g2_{s}_ref" for s in SIDES)
    keep = ", ".join(
        f"CASE WHEN g2_{p} IN {_BAD2} THEN NULL ELSE {p}_{c} END AS {p}_{c}"
        for s in SIDES for p in (s, s + "_ref") for c in ("raw", "page", "doc"))
    # Emptied copies live beside the originals, which event metadata still needs.
    original = ", ".join(f"{s}_page AS {s}_page0, {s}_doc AS {s}_doc0" for s in SIDES)
    drop = ", ".join(f"{p}_{c}" for s in SIDES for p in (s, s + "_ref") for c in ("raw", "page", "doc"))
    fee, date = in_list(TRUST_FUND.guard_range_fields), in_list(TRUST_FUND.guard_date_fields)
    bounds = "CASE field " + " ".join(
        f"WHEN {q(f)} THEN CAST({TRUST_FUND.policy(f).range_max} AS DOUBLE)" for f in TRUST_FUND.guard_range_fields) + " END"
    if constraint:
        probes = ", ".join(
            f"CASE WHEN field IN {fee} THEN {guard_percent(f'{s}_raw')} END AS pct_{s}, "
            f"CASE WHEN field IN {date} THEN {guard_date(f'{s}_raw')} END AS gd_{s}, "
            f"CASE WHEN field = {q(TRUST_FUND.order_later)} THEN {guard_date(f'{s}_ref_raw')} END AS gr_{s}" for s in SIDES)
        g3 = ", ".join(
            f"CASE WHEN {s}_raw IS NULL THEN NULL WHEN field IN {fee} THEN CASE WHEN pct_{s} IS NULL THEN 'unit_not_recognized' "
            f"WHEN pct_{s} < 0 OR pct_{s} > {bounds} THEN 'percent_range' ELSE 'percent_in_range' END "
            f"WHEN field IN {date} THEN CASE WHEN gd_{s} IS NULL THEN 'date_unparseable' ELSE 'date_parsed' END END AS g3a_{s}, "
            f"CASE WHEN field = {q(TRUST_FUND.order_later)} AND gd_{s} IS NOT NULL AND gr_{s} IS NOT NULL THEN "
            f"CASE WHEN gd_{s} <= gr_{s} THEN 'maturity_not_after_inception' ELSE 'maturity_after_inception' END END AS g3c_{s}"
            for s in SIDES)
    else:
        probes = ", ".join(f"CAST(NULL AS DOUBLE) AS pct_{s}, CAST(NULL AS DATE) AS gd_{s}, CAST(NULL AS DATE) AS gr_{s}" for s in SIDES)
        g3 = ", ".join(f"CAST(NULL AS VARCHAR) AS g3a_{s}, CAST(NULL AS VARCHAR) AS g3c_{s}" for s in SIDES)
    bad3 = lambda s: f"(coalesce(g3a_{s} = 'percent_range', FALSE) OR coalesce(g3c_{s} = 'maturity_not_after_inception', FALSE))"
    final = ", ".join(f"CASE WHEN {bad3(s)} THEN NULL ELSE {s}_{c} END AS {s}_{c}" for s in SIDES for c in ("raw", "page", "doc"))
    cells = ", ".join(f"{s}_{c}" for s in SIDES for c in ("raw", "page", "doc"))
    caught = " OR ".join(f"coalesce(g2_{s} IN {_BAD2}, FALSE) OR {bad3(s)}" for s in SIDES)
    return (
        f"g_a AS (SELECT *, {g2} FROM ev), "
        f"g_b AS (SELECT * EXCLUDE ({drop}), {original}, {keep} FROM g_a), "
        f"g_c AS (SELECT *, {probes} FROM g_b), g_d AS (SELECT *, {g3} FROM g_c), "
        f"guarded AS (SELECT * EXCLUDE ({cells}), {final}, {', '.join(f'{s}_raw AS {s}_raw0' for s in SIDES)}, "
        f"({caught}) AS guard_caught FROM g_d)")


def raw_status(left: str = "contract_raw", right: str = "im_raw") -> str:
    return (f"CASE WHEN {left} IS NULL OR {right} IS NULL THEN 'missing_evidence' "
            f"WHEN {squash(left)} = {squash(right)} THEN 'exact_match' ELSE 'needs_review' END")


MISSING_SIDE = ("CASE WHEN contract_raw IS NULL AND im_raw IS NULL THEN 'both' WHEN contract_raw IS NULL THEN 'contract' "
                "WHEN im_raw IS NULL THEN 'im' ELSE 'none' END")
RAW_REASON = case_map("status", {k: v[0] for k, v in V.RAW_REASONS.items()})


def raw_check_cte(source: str = "guarded") -> str:
    return (f"rc AS (SELECT *, {raw_status()} AS status, {MISSING_SIDE} AS missing_side FROM {source}), "
            f"checked AS (SELECT *, status AS final_status, {RAW_REASON} AS final_reason_code FROM rc)")


def policy_check_cte(source: str = "guarded", strict_text: bool = True) -> str:
    """CTE chain from guarded rows to ``checked`` under the policies."""
    value = lambda s: (
        f"CASE WHEN canonicalizer = 'maturity_date' THEN {maturity_sql(f'{s}_raw', f'{s}_ref_raw')} ELSE {value_sql(f'{s}_raw')} END")
    equal = "cv = iv"
    if not strict_text:
        equal = ("CASE WHEN compare_policy = 'numeric_equal' THEN CAST(cv AS DECIMAL(18, 9)) = CAST(iv AS DECIMAL(18, 9)) ELSE cv = iv END")
    word = case_map("compare_policy", V.POLICY_WORD, "''")
    return (
        f"{policy_cte()}, pc_a AS (SELECT s.*, p.label, p.value_type, p.canonicalizer, p.compare_policy, p.judge_allowed AS may_judge, "
        f"p.absence_semantics, p.range_min, p.range_max, {raw_status()} AS status, {MISSING_SIDE} AS missing_side FROM {source} s JOIN policy p USING (field)), "
        f"pc_b AS (SELECT *, CASE WHEN status = 'needs_review' THEN {value('contract')} END AS cv, "
        f"CASE WHEN status = 'needs_review' THEN {value('im')} END AS iv FROM pc_a), "
        "pc_c AS (SELECT *, cv IS NOT NULL AND iv IS NOT NULL AS decisive FROM pc_b), "
        f"checked AS (SELECT *, CASE WHEN status <> 'needs_review' THEN status WHEN NOT decisive THEN 'needs_review' WHEN {equal} "
        "THEN 'same_after_normalization' ELSE 'different_after_normalization' END AS final_status, "
        f"CASE WHEN status <> 'needs_review' THEN {RAW_REASON} WHEN NOT decisive THEN 'canonical_not_decisive' "
        f"ELSE 'canonical_' || {word} || CASE WHEN {equal} THEN 'equal' ELSE 'difference' END END AS final_reason_code, "
        "status = 'needs_review' AND may_judge AS judge_allowed FROM pc_c)")


def scored_cte(source: str = "checked", caught: str = "guard_caught") -> str:
    return (
        f"sc_a AS (SELECT *, CASE WHEN {caught} THEN 'mismatch' ELSE {case_map('final_status', V.FINAL_TO_PREDICTED)} END AS predicted_label FROM {source}), "
        "sc_b AS (SELECT *, CASE WHEN gold_label = 'missing' THEN 'MISSING' WHEN gold_label = 'mismatch' THEN CASE WHEN predicted_label = 'mismatch' THEN 'TP' ELSE 'FN' END "
        "WHEN predicted_label = 'mismatch' THEN 'FP' WHEN predicted_label = 'review' THEN 'REVIEW' ELSE 'TN' END AS bucket FROM sc_a), "
        "scored AS (SELECT *, CASE WHEN gold_label = 'missing' THEN predicted_label = 'missing' ELSE bucket IN ('TP', 'TN') END AS correct FROM sc_b)")


COUNT_SQL = (
    "count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (bucket = 'TP') AS tp, count(*) FILTER (bucket = 'FP') AS fp, "
    "count(*) FILTER (bucket = 'FN') AS fn, count(*) FILTER (bucket = 'TN') AS tn, count(*) FILTER (bucket = 'REVIEW') AS review, "
    "count(*) FILTER (bucket = 'MISSING') AS missing, count(*) FILTER (gold_label = 'missing' AND predicted_label <> 'missing') AS hallucinated, "
    "count(*) FILTER (predicted_label = 'review') AS predicted_review")


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"


PRECISION, RECALL = div("tp", "tp + fp"), div("tp", "tp + fn")
# F measures straight from counts: F_b = (1 + b^2) tp / ((1 + b^2) tp + b^2 fn + fp).
F1 = div("2 * tp", "CASE WHEN tp > 0 THEN 2 * tp + fp + fn ELSE 0 END")
F2 = div("5 * tp", "CASE WHEN tp > 0 THEN 5 * tp + 4 * fn + fp ELSE 0 END")
ACCURACY = div("tp + tn", "tp + tn + fp + fn + review")
EI = "(1 - (2.5 + fp * 2.0) / 180.0) * 100"
METRIC_SQL = (
    f"round({ACCURACY}, 6) AS accuracy, round({PRECISION}, 6) AS precision, round({RECALL}, 6) AS recall, round({F1}, 6) AS f1, "
    f"round({F2}, 6) AS f2, round(CAST({EI} AS DOUBLE), 6) AS efficiency_index_pct, round({div('hallucinated', 'missing')}, 6) AS hallucination_rate, "
    f"round({div('predicted_review', 'n')}, 6) AS review_rate")


def mode_cte(mode: str, tables: tuple[str, ...] = tuple(L.ANCHORS), strict_text: bool = True) -> str:
    """Whole chain from the tables to ``scored`` for one evaluation mode."""
    on = mode in ("guard", "ontology_policy")
    check = policy_check_cte("guarded", strict_text) if mode == "ontology_policy" else raw_check_cte()
    return f"{case_evidence_cte(tables)}, {guard_cte(on, on)}, {check}, {scored_cte()}"
