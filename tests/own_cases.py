"""Labelled cases built from a grid of values and notations.

Each block says what policy mode must answer, so the confusion counts follow by adding up:

=============  =====  ==========================================================
block          cases  policy mode
=============  =====  ==========================================================
fees               9  three values in three notations: 6 equal (tn), 3 off (tp)
dates              4  two days: ISO of the same day (tn), dots of the next (tp)
redeemability      2  same answer (tn), opposite answer (tp)
names              7  3 equal texts (tn), 2 reworded (review), 2 others (fn, in review)
absences           2  one side empty (missing)
citations          2  page beyond the document; only used where guards are tested
=============  =====  ==========================================================
"""

SCHEMA = ("case_id string, field string, gold_label string, mutation_type string, difficulty string, "
          "contract_raw string, contract_page int, im_raw string, im_page int, harness_signal string")


def _rows():
    for permille in ("2.5", "7", "15"):
        percent = float(permille) / 10
        left = f"연 1,000분의 {permille}"
        yield "fee_schedule.management_fee", "match", "unit_conversion", "easy", left, 3, f"연 {percent:g} %", 4
        yield "fee_schedule.trust_fee", "match", "unit_conversion", "hard", left, 3, f"연 {percent * 100:g}bp", 4
        yield "fee_schedule.sales_fee", "mismatch", "digit_swap", "hard", left, 3, f"연 {percent + 0.1:g} %", 4
    for month, day in ((5, 9), (11, 28)):
        left = f"2031년 {month}월 {day}일"
        yield "fund.inception_date", "match", "format_diff", "easy", left, 1, f"2031-{month:02d}-{day:02d}", 2
        yield "fund.inception_date", "mismatch", "date_shift", "medium", left, 1, f"2031.{month:02d}.{day + 1:02d}", 2
    yield "redemption_terms.is_redeemable", "match", "semantic_equivalent", "easy", "환매 가능", 5, "중도환매가 허용됩니다", 6
    yield "redemption_terms.is_redeemable", "mismatch", "negation_flip", "hard", "환매 가능", 5, "환매 불가", 6
    for i in range(3):
        yield "party.trustee", "match", "identity", "easy", f"바다증권 {i}", 7, f"바다증권 {i}", 8
    for i in range(2):
        yield "party.trustee", "match", "format_diff", "medium", f"바다증권 {i}", 7, f"바다 증권사 제{i}", 8
        yield "party.trustee", "mismatch", "char_typo", "hard", f"바다증권 {i}", 7, f"하늘증권 {i}", 8
    yield "party.distributor", "missing", "missing_one_side", "easy", "들판은행", 9, None, None
    yield "party.distributor", "missing", "missing_one_side", "easy", None, None, "들판은행", 9


def own_cases(spark, citations=False):
    rows = list(_rows())
    if citations:
        rows = [(f, "mismatch", "fake_citation", d, c, cp, im, 99) for f, _, _, d, c, cp, im, _ in rows[:1] + rows[9:10]]
    return spark.createDataFrame([(f"case-{i}", *r, "own") for i, r in enumerate(rows)], SCHEMA)
