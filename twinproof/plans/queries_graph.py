"""Queries over graph constraints and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.operators import constraints as K
from twinproof.operators import evidence, scoring, stats
from twinproof.plans import oracle as O
from twinproof.plans import workload as L
from twinproof.plans.queries_core import all_modes_cte, _all_modes, guarded_pairs, pair_rows
from twinproof.plans.registry import query, round_all, rounded
from twinproof.profile import SIDES, TRUST_FUND

_PRED = "CASE field WHEN 'fund.name' THEN 'fund_name' WHEN 'fund.type' THEN 'fund_type' ELSE split_part(field, '.', 2) END"
_RAW_T = " UNION ALL ".join(
    f"SELECT pair_id AS graph_id, split_part(field, '.', 1) || '_{s}' AS s, {_PRED} AS p, {s}_raw AS o, 'literal' AS o_kind FROM {{src}} WHERE {s}_raw IS NOT NULL"
    for s in SIDES)
_STRUCT_ROWS = [(f"{sec}_{s}", K.RDF_TYPE, c) for s in SIDES for sec, c in K.CLASSES.items()] + [
    (f"fund_{s}", link, f"{sec}_{s}") for s in SIDES for sec, link in K.LINKS.items()]
_STRUCT_T = ("SELECT pair_id AS graph_id, v.s, v.p, v.o, 'iri' AS o_kind FROM (SELECT DISTINCT pair_id FROM {src}) CROSS JOIN (VALUES "
             + ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in _STRUCT_ROWS) + ") AS v(s, p, o)")


def triples_cte(src: str) -> str:
    return f"triples AS ({_STRUCT_T.replace('{src}', src)} UNION ALL {_RAW_T.replace('{src}', src)})"


_EV = L.pairs_sql()
_GD = f"{_EV}, {O.guard_cte()}"


@query(f"WITH {_EV}, {triples_cte('ev')} SELECT graph_id, s, p, o, o_kind FROM triples")
def evidence_triples(spark, sf_dir):
    return K.extraction_triples(L.extractions(spark, sf_dir)).select("graph_id", "s", "p", "o", "o_kind")


@query(f"WITH {_EV} SELECT p, o_datatype, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT split_part(field, '.', 2) || '_{suffix}' AS p, {dt} AS o_datatype FROM ev WHERE {s}_{col} IS NOT NULL"
    for s in SIDES for suffix, col, dt in (("raw_text", "raw", "NULL"), ("document", "doc", "NULL"), ("page", "page", "'xsd:integer'"))) + ") GROUP BY 1, 2")
def detailed_triples(spark, sf_dir):
    return K.detailed_triples(pair_rows(spark, sf_dir)).groupBy("p", "o_datatype").agg(F.count(F.lit(1)).alias("n"))


_NV = " UNION ALL ".join(
    f"SELECT pair_id AS graph_id, split_part(field, '.', 1) || '_{s}' AS subject, split_part(field, '.', 2) AS leaf, {v} AS value, '{s}' AS side FROM ev WHERE {w}"
    for s in SIDES for v, w in ((O.percent_value(f"{s}_raw"), "field LIKE 'fee_schedule.%'"),
                                (O.date_value(f"{s}_raw"), "field IN ('fund.inception_date', 'fund.maturity_date')")))


def normalized_evidence(spark, sf_dir) -> DataFrame:
    """Long evidence with normalized predicates joined on (pair, field)."""
    from twinproof.functions import canonical as C
    from twinproof.operators.compare import settle_sides, with_policy

    rows = with_policy(pair_rows(spark, sf_dir)).withColumn(
        "canonicalizer", F.when(F.col("canonicalizer") == "maturity_date", F.lit("date")).otherwise(F.col("canonicalizer")))
    staged = settle_sides(rows, F.col("canonicalizer").isin("percent", "date"), derive=False)
    staged = staged.filter(F.col("field").startswith("fee_schedule.") | (F.col("canonicalizer") == "date"))
    return staged.select("pair_id", "field", *[C.value_of(F.col(f"_{s}")).alias(f"{s}_normalized_value") for s in SIDES],
                         *[F.when(F.length(f"_{s}") > 2, C.unit_of(F.col(f"_{s}"), F.col("value_type"))).alias(f"{s}_normalized_unit") for s in SIDES])


@query(f"WITH {_EV}, nv AS ({_NV}) SELECT graph_id, subject AS s, leaf || '_normalized_value' AS p, value AS o, CASE WHEN leaf LIKE '%date' THEN NULL ELSE 'xsd:decimal' END AS o_datatype FROM nv WHERE value IS NOT NULL")
def normalized_predicates(spark, sf_dir):
    out = K.detailed_triples(normalized_evidence(spark, sf_dir))
    return out.filter(F.col("p").endswith("_normalized_value")).select("graph_id", "s", "p", "o", "o_datatype")


@query(f"WITH {_EV}, nv AS ({_NV}), fee AS (SELECT graph_id, subject, leaf || '_normalized_value' AS field, value FROM nv WHERE leaf LIKE '%fee' AND "
       "(CAST(value AS DOUBLE) < 0 OR CAST(value AS DOUBLE) > CASE leaf WHEN 'management_fee' THEN 5 WHEN 'trust_fee' THEN 2 ELSE 3 END)), "
       "dt AS (SELECT a.graph_id, a.subject, 'maturity_date_normalized_value' AS field, b.value FROM nv a JOIN nv b USING (graph_id, subject) WHERE a.leaf = 'inception_date' AND b.leaf = 'maturity_date' AND b.value <= a.value) "
       "SELECT graph_id, subject, field, value FROM fee UNION ALL SELECT * FROM dt")
def normalized_rule_violations(spark, sf_dir):
    return K.normalized_rules(K.detailed_triples(normalized_evidence(spark, sf_dir))).select("graph_id", "subject", "field", "value")


@query(f"WITH {_GD}, {triples_cte('guarded')} SELECT graph_id, node, cls FROM (SELECT graph_id, s AS node, CASE split_part(s, '_', 1) WHEN 'fund' THEN 'Fund' WHEN 'party' THEN 'Party' "
       "WHEN 'fee' THEN 'FeeSchedule' ELSE 'RedemptionTerms' END AS cls FROM triples) GROUP BY ALL")
def inferred_types(spark, sf_dir):
    """Domain and range typing plus stated types."""
    guarded = guarded_pairs(spark, sf_dir)
    triples = K.raw_triples(guarded).unionByName(K.structure_triples(L.extractions(spark, sf_dir).select("pair_id")))
    return K.infer_types(triples)


_KD = r"([0-9]{4})\s*년\s*([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일"


def _kn(x):
    return (f"CASE WHEN regexp_matches({x}, '{_KD}') THEN CAST(regexp_extract({x}, '{_KD}', 1) AS INT) * 10000 + CAST(regexp_extract({x}, '{_KD}', 2) AS INT) * 100 "
            f"+ CAST(regexp_extract({x}, '{_KD}', 3) AS INT) END")


from twinproof.plans.queries_core import _SHAPE_PCT  # noqa: E402

_VIOL = " UNION ALL ".join(
    [f"SELECT pair_id AS graph_id, 'fund_{s}' AS focus, 'fund_name_min' AS \"constraint\" FROM guarded WHERE field = 'fund.name' AND {s}_raw IS NULL" for s in SIDES]
    + [f"SELECT pair_id, 'fee_schedule_{s}', 'management_fee_min' FROM guarded WHERE field = 'fee_schedule.management_fee' AND {s}_raw IS NULL" for s in SIDES]
    + [f"SELECT pair_id, 'party_{s}', '{s}_asset_manager_min' FROM guarded WHERE field = 'party.asset_manager' AND {s}_raw IS NULL" for s in SIDES]
    + ["SELECT pair_id, 'party_contract', 'contract_trustee_exactly_one' FROM guarded WHERE field = 'party.trustee' AND contract_raw IS NULL"]
    + [f"SELECT a.pair_id, 'fund_{s}', 'maturity_order' FROM guarded a JOIN guarded b USING (pair_id) WHERE a.field = 'fund.inception_date' AND b.field = 'fund.maturity_date' AND {_kn(f'b.{s}_raw')} <= {_kn(f'a.{s}_raw')}" for s in SIDES]
    + [f"SELECT pair_id, 'fee_schedule_{s}', 'management_fee_range' FROM guarded WHERE field = 'fee_schedule.management_fee' AND ({_SHAPE_PCT.replace('{x}', f'{s}_raw')} < 0 OR {_SHAPE_PCT.replace('{x}', f'{s}_raw')} > 5)" for s in SIDES])


def _graph(spark, sf_dir) -> DataFrame:
    return K.raw_triples(guarded_pairs(spark, sf_dir), structure=True)


@query(f"WITH {_GD} {_VIOL}")
def shape_violations(spark, sf_dir):
    """Cardinality, link class, value range and date order rules over the guarded graph."""
    return K.shape_violations(_graph(spark, sf_dir)).select("graph_id", "focus", "constraint")


@query(f"WITH {_EV}, guarded AS (SELECT * FROM ev), v AS ({_VIOL}) SELECT \"constraint\", count(*) AS n FROM v GROUP BY 1")
def shape_violations_unguarded(spark, sf_dir):
    out = K.shape_violations(K.extraction_triples(L.extractions(spark, sf_dir)))
    return out.groupBy("constraint").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GD}, v AS ({_VIOL}), g AS (SELECT DISTINCT pair_id AS graph_id FROM ev), c AS (SELECT graph_id, count(v.focus) AS n_violations FROM g LEFT JOIN v USING (graph_id) GROUP BY 1) "
       "SELECT graph_id, n_violations, n_violations = 0 AS conforms, CASE WHEN n_violations = 0 THEN 'shacl_conforms' ELSE 'shacl_violation' END AS reason_code FROM c")
def graph_conformance(spark, sf_dir):
    return K.conformance(_graph(spark, sf_dir)).withColumn("reason_code", F.when(F.col("conforms"), F.lit("shacl_conforms")).otherwise(F.lit("shacl_violation")))


@query(f"WITH {_EV} SELECT graph_id, 'fund_' || side AS focus, 'has_party_link' AS \"constraint\" FROM (SELECT pair_id AS graph_id, unnest(['contract', 'im']) AS side FROM (SELECT DISTINCT pair_id FROM ev)) "
       "WHERE side = 'im' AND CAST(substr(graph_id, 2) AS BIGINT) % 3 = 0")
def link_class_violations(spark, sf_dir):
    """Every third graph lacks the type of its memo party; without inference its link is broken."""
    triples = K.structure_triples(L.extractions(spark, sf_dir).select("pair_id"))
    third = F.substring("graph_id", 2, 20).cast("bigint") % 3 == 0
    broken = triples.filter(~(third & (F.col("s") == "party_im") & (F.col("p") == K.RDF_TYPE)))
    return K.link_class_violations(broken, infer=False)


@query(f"WITH {_EV}, {triples_cte('ev')} SELECT graph_id, '<urn:twinproof:data#' || graph_id || '/' || s || '> ' || CASE WHEN p = 'rdf:type' THEN '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' ELSE '<urn:twinproof:ontology#' || p || '>' END || ' ' || "
       "CASE WHEN p = 'rdf:type' THEN '<urn:twinproof:ontology#' || o || '>' WHEN o_kind = 'iri' THEN '<urn:twinproof:data#' || graph_id || '/' || o || '>' ELSE '\"' || o || '\"' END || ' .' AS line FROM triples")
def triple_lines(spark, sf_dir):
    triples = K.extraction_triples(L.extractions(spark, sf_dir))
    lines = K.triple_lines(triples).select(F.col("value").alias("line"))
    return lines.select(F.regexp_extract("line", r"^<urn:twinproof:data#([^/]+)/", 1).alias("graph_id"), "line")


@query("SELECT event_id, replace(replace(replace('a\\' || props || chr(10), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') AS escaped FROM events")
def literal_escape(spark, sf_dir):
    from twinproof.functions.text import escape_literal

    text = F.concat(F.lit("a\\"), F.col("props"), F.lit("\n"))
    return L.table(spark, sf_dir, "events").select("event_id", escape_literal(text).alias("escaped"))


@query(f"WITH {_GD}, v AS ({_VIOL}), g AS (SELECT DISTINCT pair_id FROM ev), c AS (SELECT g.pair_id, count(v.focus) AS n FROM g LEFT JOIN v ON v.graph_id = g.pair_id GROUP BY 1) "
       "SELECT pair_id, 'G3' AS guard, CASE WHEN n = 0 THEN 'pass' ELSE 'reject' END AS decision, CASE WHEN n = 0 THEN 'shacl_conforms' ELSE 'shacl_violation' END AS reason_code FROM c")
def review_audit(spark, sf_dir):
    """The review's graph audit as the guard chain's last event, one per pair."""
    from twinproof.plans import review

    _, conforming = review.audit(guarded_pairs(spark, sf_dir), "pair_id")
    return K.shape_event(conforming)


# --- statistics ---------------------------------------------------------------------------------------------

_JUDGES = ("judged AS (SELECT d.doc_id, l.quality, d.n_chars > 1000 AS a, d.n_chars % 5 <> 0 AS b FROM labels l JOIN documents d USING (doc_id))")


def judged_documents(spark, sf_dir) -> DataFrame:
    """Labelled documents with two rule predictions; the label table decides the join size."""
    docs = L.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("a"), (F.col("n_chars") % 5 != 0).alias("b"))
    return L.table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")


def _mode_correct(spark, sf_dir) -> DataFrame:
    docs = judged_documents(spark, sf_dir)
    good = F.col("quality") == 1
    both = F.explode(F.array(
        F.struct(F.lit("a").alias("mode"), (F.col("a") == good).alias("correct"), F.col("a").alias("predicted")),
        F.struct(F.lit("b").alias("mode"), (F.col("b") == good).alias("correct"), F.col("b").alias("predicted"))))
    return docs.select(F.col("doc_id").alias("case_id"), "quality", both.alias("m")).select("case_id", "quality", "m.*")


@query(f"WITH {_JUDGES} SELECT doc_id AS case_id, a = (quality = 1) AS mode_a, b = (quality = 1) AS mode_b FROM judged")
def aligned_correctness(spark, sf_dir):
    return stats.align_modes(_mode_correct(spark, sf_dir), ["a", "b"], "correct")


# erfc(x) by the positive series of erf; p of chi-square(1) is erfc(sqrt(x / 2)).
def _erfc(x: str) -> str:
    series = f"list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln({x}) + i * ln(2.0) - (lgamma(2 * i + 2.0) - i * ln(2.0) - lgamma(i + 1.0)))))"
    return f"CASE WHEN {x} > 0 THEN 1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * {series} ELSE 1.0 END"


_BC = ("bc AS (SELECT count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM (SELECT a = (quality = 1) AS x, b = (quality = 1) AS y FROM judged))")
_TAIL = "list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2.0))))"


@query(f"WITH {_JUDGES}, {_BC} SELECT b, c, b + c AS n, CASE WHEN b + c < 25 THEN CAST(least(b, c) AS DOUBLE) ELSE round(CAST((abs(b - c) - 1) * (abs(b - c) - 1) AS DOUBLE) / (b + c), 6) END AS statistic, "
       f"CASE WHEN b + c = 0 THEN 'no_discordant' WHEN b + c < 25 THEN 'exact_binomial' ELSE 'chi2_continuity' END AS method, "
       f"round(CASE WHEN b + c = 0 OR (b + c < 25 AND b = c) THEN 1.0 WHEN b + c < 25 THEN least(1.0, 2 * {_TAIL}) ELSE {_erfc('sqrt(CAST((abs(b - c) - 1) * (abs(b - c) - 1) AS DOUBLE) / (b + c) / 2)')} END, 6) AS p_value FROM bc")
def mcnemar(spark, sf_dir):
    counts = stats.discordance(stats.align_modes(_mode_correct(spark, sf_dir), ["a", "b"], "correct"), "a", "b")
    out = round_all(stats.mcnemar(counts), "statistic").withColumn("p_value", F.round("p_value", 6))
    return out.select("b", "c", "n", "statistic", "method", "p_value")


@query(f"WITH {_JUDGES}, {_BC} SELECT b, c, round(CASE WHEN b = c THEN 1.0 ELSE least(1.0, 2 * {_TAIL}) END, 9) AS p_value FROM bc")
def mcnemar_exact(spark, sf_dir):
    """The exact test, forced whatever the number of discordant pairs."""
    counts = stats.discordance(stats.align_modes(_mode_correct(spark, sf_dir), ["a", "b"], "correct"), "a", "b")
    return stats.mcnemar(counts, exact=True).select("b", "c", rounded("p_value", 9).alias("p_value"))


@query(f"WITH {all_modes_cte()}, w AS (SELECT case_id, max(CASE WHEN mode = 'ontology' THEN predicted_label END) AS mode_ontology, max(CASE WHEN mode = 'ontology_policy' THEN predicted_label END) AS mode_ontology_policy, max(gold_label) AS gold_label FROM all_scored GROUP BY 1) "
       "SELECT gold_label, mode_ontology, mode_ontology_policy, count(*) AS n FROM w GROUP BY ALL")
def paired_labels(spark, sf_dir):
    from twinproof.sources.sinks import paired_labels as paired

    table, _ = paired(_all_modes(spark, sf_dir), ["ontology", "ontology_policy"])
    return table.groupBy("gold_label", "mode_ontology", "mode_ontology_policy").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(doc_id AS BIGINT) AS case_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skipped_cases(spark, sf_dir):
    docs = L.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit("documents").alias("mode"))
    labels = L.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.lit("labels").alias("mode"))
    return stats.skipped_cases(docs.unionByName(labels), ["documents", "labels"])


def _flags(spark, sf_dir) -> DataFrame:
    docs = judged_documents(spark, sf_dir)
    label = lambda c: F.when(c, "mismatch").otherwise("match")
    return stats.mismatch_flags(docs.select(label(F.col("quality") == 0).alias("gold_label"), label(~F.col("a")).alias("predicted_label")))


@query(f"WITH {_JUDGES}, c AS (SELECT count(*) FILTER (quality = 0 AND NOT a) AS tp, count(*) FILTER (quality <> 0 AND NOT a) AS fp, count(*) FILTER (quality = 0 AND a) AS fn, count(*) FILTER (quality <> 0 AND a) AS tn FROM judged) "
       f"SELECT tp, fp, fn, tn, round({O.F1}, 6) AS point FROM c")
def bootstrap_point(spark, sf_dir):
    """The four cells a bootstrap replicate depends on, and the point estimate."""
    cells = stats.f1_cells(_flags(spark, sf_dir))
    return cells.withColumn("point", rounded(stats.f1_of(F.col("tp"), F.col("fp"), F.col("fn")))).select("tp", "fp", "fn", "tn", "point")


@query()
def bootstrap_interval(spark, sf_dir):
    """Seeded percentile interval of F1 (checked against brute-force resampling in the tests)."""
    return stats.bootstrap_f1(_flags(spark, sf_dir))


def event_reps(spark, sf_dir) -> DataFrame:
    """Event values as repeated-run metrics: tier = event type, metric = day parity."""
    e = L.table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("tier"), F.when(F.dayofmonth("ts") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("metric"), "value")


_REPS = "reps AS (SELECT event_type AS tier, CASE WHEN day(ts) % 2 = 0 THEN 'even' ELSE 'odd' END AS metric, value FROM events)"
# Student t two-sided p: substitute t = sqrt(df) tan(a) and integrate cos^(df-1) by Simpson's rule.
_T_P = ("1 - 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * (atan(abs(t) / sqrt(dof)) / 2000) / 3 * list_sum(list_transform(range(0, 2001), "
        "lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(atan(abs(t) / sqrt(dof)) * i / 2000), dof - 1)))")


@query(f"WITH {_REPS} SELECT tier, metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max, round(median(value), 6) AS median FROM reps GROUP BY 1, 2")
def rep_descriptives(spark, sf_dir):
    out = stats.describe(event_reps(spark, sf_dir), "tier", "metric")
    return round_all(out, "mean", "sd", "median").select("tier", "metric", "n", "mean", "sd", "min", "max", "median")


# The critical value by halving steps: the largest t whose two-sided p still exceeds 0.05.
_T_CRIT = ("list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(0, 46), lambda j: 16.0 / pow(2.0, j))), "
           f"lambda acc, step: CASE WHEN {_T_P.replace('abs(t)', '(acc + step)')} > 0.05 THEN acc + step ELSE acc END)")


@query(f"WITH {_REPS}, m AS (SELECT tier, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, CAST(count(*) - 1 AS DOUBLE) AS dof FROM reps GROUP BY 1, 2), "
       f"h AS (SELECT *, CASE WHEN n > 1 AND sd > 0 THEN {_T_CRIT} * sd / sqrt(n) ELSE 0.0 END AS half FROM m) SELECT tier, metric, round(mean - half, 6) AS ci_lo, round(mean + half, 6) AS ci_hi FROM h")
def rep_intervals(spark, sf_dir):
    """t intervals of the means."""
    out = stats.describe(event_reps(spark, sf_dir), "tier", "metric")
    return round_all(out, "ci_lo", "ci_hi").select("tier", "metric", "ci_lo", "ci_hi")


_MOM = f"{_REPS}, m AS (SELECT tier, metric, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM reps GROUP BY 1, 2)"


@query(f"WITH {_MOM}, j AS (SELECT a.metric, a.mean - b.mean AS gap, a.var / a.n AS ea, b.var / b.n AS eb, a.n AS na, b.n AS nb, sqrt((a.var + b.var) / 2) AS s FROM m a JOIN m b USING (metric) WHERE a.tier = 'click' AND b.tier = 'view'), "
       "w AS (SELECT metric, gap, gap / s AS d, gap / sqrt(ea + eb) AS t, (ea + eb) * (ea + eb) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) AS dof FROM j) "
       f"SELECT metric, round(gap, 6) AS mean_diff, round(d, 6) AS cohens_d, round(t, 6) AS t_stat, round(dof, 4) AS dof, round({_T_P}, 6) AS p_value FROM w")
def welch_test(spark, sf_dir):
    m = stats.moments(event_reps(spark, sf_dir), "tier", "metric")
    out = round_all(stats.two_sample(m, "click", "view", ["metric"]), "mean_diff", "cohens_d", "t_stat", "p_value")
    return out.withColumn("dof", F.round("dof", 4)).select("metric", "mean_diff", "cohens_d", "t_stat", "dof", "p_value")


@query(f"WITH {_MOM}, w AS (SELECT a.metric, a.mean - b.mean AS gap, (a.mean - b.mean) / sqrt(a.var / a.n) AS t, CAST(a.n - 1 AS DOUBLE) AS dof FROM m a JOIN m b USING (metric) WHERE a.tier = 'purchase' AND b.tier = 'error') "
       f"SELECT metric, round(gap, 6) AS mean_diff, round(t, 6) AS t_stat, round({_T_P}, 6) AS p_value FROM w")
def one_sample_test(spark, sf_dir):
    m = stats.moments(event_reps(spark, sf_dir), "tier", "metric")
    return round_all(stats.one_sample(m, "purchase", "error", ["metric"]), "mean_diff", "t_stat", "p_value").select(
        "metric", "mean_diff", "t_stat", "p_value")


_MWU = (f"{_REPS}, s AS (SELECT * FROM reps WHERE tier IN ('click', 'view')), r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS rk FROM s), "
        "t AS (SELECT metric, sum(CAST(k AS DOUBLE) * k * k - k) AS ties FROM (SELECT metric, value, count(*) AS k FROM s GROUP BY 1, 2) GROUP BY 1), "
        "u AS (SELECT metric, CAST(count(*) FILTER (tier = 'click') AS DOUBLE) AS na, CAST(count(*) FILTER (tier = 'view') AS DOUBLE) AS nb, sum(rk) FILTER (tier = 'click') AS ra FROM r GROUP BY 1), "
        "z AS (SELECT metric, na, nb, ra - na * (na + 1) / 2 AS u1, sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))) AS sg FROM u JOIN t USING (metric))")


@query(f"WITH {_MWU} SELECT metric, n_a, n_b, u_stat, round(z, 6) AS z, round(least(1.0, {_erfc('z / sqrt(2.0)')}), 6) AS p_value FROM (SELECT metric, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(CAST(u1 AS DOUBLE), 3) AS u_stat, (greatest(u1, na * nb - u1) - na * nb / 2 - 0.5) / sg AS z FROM z)")
def mann_whitney(spark, sf_dir):
    out = stats.mann_whitney(event_reps(spark, sf_dir), "click", "view", ["metric"])
    return out.select("metric", "n_a", "n_b", F.round("u_stat", 3).alias("u_stat"), rounded("z").alias("z"), rounded("p_value").alias("p_value"))


_SIG = (f"WITH {_MWU}, m AS (SELECT tier, metric, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM reps GROUP BY 1, 2), "
        "j AS (SELECT metric, a.mean - b.mean AS gap, a.var / a.n AS ea, b.var / b.n AS eb, a.n AS na, b.n AS nb, sqrt((a.var + b.var) / 2) AS s FROM m a JOIN m b USING (metric) WHERE a.tier = 'click' AND b.tier = 'view'), "
        "w AS (SELECT metric, 'click vs view' AS comparison, 'welch_t' AS test, gap, gap / s AS d, gap / sqrt(ea + eb) AS t, (ea + eb) * (ea + eb) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) AS dof FROM j "
        "UNION ALL SELECT metric, a.tier || ' vs error', 'one_sample_t', a.mean - b.mean, NULL, (a.mean - b.mean) / sqrt(a.var / a.n), CAST(a.n - 1 AS DOUBLE) FROM m a JOIN m b USING (metric) WHERE a.tier IN ('click', 'view') AND b.tier = 'error'), "
        f"mw AS (SELECT metric, least(1.0, {_erfc('zz / sqrt(2.0)')}) AS p FROM (SELECT metric, (greatest(u1, na * nb - u1) - na * nb / 2 - 0.5) / sg AS zz FROM z)), "
        f"p AS (SELECT *, {_T_P} AS p_value FROM w) "
        "SELECT metric, comparison, test, round(gap, 6) AS mean_diff, round(d, 6) AS cohens_d, round(t, 6) AS t_stat, round(dof, 4) AS dof, round(p_value, 6) AS p_value, p_value < 0.05 AS significant_p05, "
        "CASE WHEN test = 'welch_t' THEN round(mw.p, 6) END AS mannwhitney_p FROM p LEFT JOIN mw USING (metric)")


@query(_SIG)
def significance_table(spark, sf_dir):
    """Three comparisons per metric with every p value."""
    out = stats.significance_table(event_reps(spark, sf_dir), "error", "view", "click", ["even", "odd"])
    return round_all(out, "mean_diff", "cohens_d", "t_stat", "p_value", "mannwhitney_p").withColumn("dof", F.round("dof", 4))


@query(f"WITH {_JUDGES}, k AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (a AND b) AS x, count(*) FILTER (a AND NOT b) AS y, count(*) FILTER (NOT a AND b) AS w, count(*) FILTER (NOT a AND NOT b) AS v FROM judged), "
       "e AS (SELECT CAST(n AS BIGINT) AS n, (x + v) / n AS observed, (CAST((x + y) AS DOUBLE) * (x + w) + CAST((w + v) AS DOUBLE) * (y + v)) / (n * n) AS expected FROM k) "
       "SELECT n, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS kappa FROM e")
def labeller_kappa(spark, sf_dir):
    return round_all(stats.kappa(judged_documents(spark, sf_dir), "a", "b"), "observed", "expected", "kappa").select(
        "n", "observed", "expected", "kappa")


@query("WITH c AS (SELECT user_id, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS runs, count(*) OVER (PARTITION BY user_id) AS vals, "
       "row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS k FROM c) SELECT user_id, v AS majority_value, n AS n_agree, CAST(runs AS BIGINT) AS n_runs, vals AS n_values, round(CAST(n AS DOUBLE) / runs, 6) AS agreement FROM r WHERE k = 1")
def majority_vote(spark, sf_dir):
    """Most frequent value per key over repeated observations."""
    out = stats.majority(L.table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return round_all(out, "agreement")


@query("SELECT event_type AS tier, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 2) AS tp, round(avg(CASE WHEN value <= 10 THEN 1.0 ELSE 0.0 END), 2) AS fn FROM events GROUP BY 1")
def mean_confusion(spark, sf_dir):
    e = L.table(spark, sf_dir, "events")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 2)
    return e.groupBy(F.col("event_type").alias("tier")).agg(share(F.col("value") > 10).alias("tp"), share(F.col("value") <= 10).alias("fn"))
