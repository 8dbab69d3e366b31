"""Review runs, keyed merges, refusals, modes, resumed runs and result sinks on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from own_cases import own_cases
from twinproof.operators import constraints, evidence, guards, inference, overlay, stats
from twinproof.plans import modes, queries_review as Q, review, workload
from twinproof.profile import SIDES, TRUST_FUND, load_field_policies
from twinproof.sources import sinks, tables

SF = "/root/testdata/sf0.001"
KEYS = ["pair_id", "run_id"]


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pairs") / "rows")
    workload.extractions(spark, SF).filter("substr(pair_id, 2) % 10 = 3").coalesce(4).write.parquet(path)
    return spark.read.parquet(path)


# --- shapes in the guard chain ---------------------------------------------------------------------


@pytest.mark.parametrize("guarded", [True, False])
def test_row_rules_equal_the_graph_rules(spark, pairs, guarded):
    """Rules read from a pair's cells break where the rules over its graph break."""
    options = guards.GuardOptions(citation=guarded, constraint=guarded, use_shapes=True)
    shaped = guards.with_shape_event(pairs, options=options)
    told = shaped.select("pair_id", F.explode(F.split(F.col("shape_event.metadata")["violations"], "; ")).alias("v"))
    long = evidence.flatten(pairs, ["pair_id", "contract_pages", "im_pages"])
    graph = constraints.shape_violations(constraints.raw_triples(guards.apply_guards(long, options, with_events=False), "pair_id", structure=True))
    want = {(r.graph_id, f"{r.focus} {r.constraint}") for r in graph.collect()}
    assert {(r.pair_id, r.v) for r in told.collect()} == want and want
    clean = {r.pair_id for r in shaped.filter("shape_event.reason_code = 'shacl_conforms'").collect()}
    assert clean == {r.pair_id for r in pairs.collect()} - {p for p, _ in want}


def test_shape_event_ends_the_chain(spark, pairs):
    rows = review.review_rows(pairs, ["pair_id"], options=guards.GuardOptions(use_shapes=True))
    chains = {}
    for r in guards.explode_events(rows, ["pair_id", "ord"]).collect():
        chains.setdefault(r.pair_id, []).append(r)
    for chain in chains.values():
        assert [e.field_path for e in chain].count(None) == 1 and chain[-1].field_path is None and chain[-1].ord == 13
    with pytest.raises(ValueError):
        guards.apply_guards(evidence.flatten(pairs, ["pair_id", "contract_pages", "im_pages"]), guards.GuardOptions(use_shapes=True))


def test_guards_on_some_rows_only(spark, pairs):
    long = evidence.flatten(pairs, ["pair_id", "contract_pages", "im_pages"])
    on = F.col("field") < "g"
    every = {(r.pair_id, r.field): r for r in guards.apply_guards(long).select("pair_id", "field", "im_raw", "guard_events", "guard_caught").collect()}
    before = {(r.pair_id, r.field): r.im_raw for r in long.collect()}
    for r in guards.apply_guards(long, where=on).collect():
        key = r.pair_id, r.field
        if r.field < "g":
            assert (r.im_raw, r.guard_events, r.guard_caught) == every[key][2:]
        else:
            assert (r.im_raw, r.guard_events, r.guard_caught) == (before[key], [], False)


# --- the whole review ------------------------------------------------------------------------------


def test_review_parts_belong_together(spark, pairs, tmp_path):
    run = review.operational_review(pairs, KEYS, str(tmp_path / "r"), Q.rule_judge, Q.nation_aliases(spark, SF))
    fields = run.fields.collect()
    assert len(fields) == 14 * pairs.count() == 14 * run.audit.count()
    assert {"alias_registry", "llm_judge", "deterministic", "unresolved"} == {r.resolution_source for r in fields}
    assert all(e.field_path.startswith(r.field + ".") for r in fields for e in r.related_events)
    n_events = sum(len(r.related_events) for r in fields)
    assert run.events.count() == n_events + run.audit.count()
    asked = {(r.pair_id, r.field) for r in run.answers.collect()}
    assert asked and not asked & {(r.pair_id, r.field) for r in fields if r.resolution_source == "alias_registry"}
    audit = {r.pair_id: (r.conforms, r.n_violations, r.violations) for r in run.audit.collect()}
    assert {True, False} == {c for c, _, _ in audit.values()}
    assert all(c == (n == 0) and (v is None or len(v.split("; ")) == n) for c, n, v in audit.values())


def test_review_without_judge_and_with_a_failing_one(spark, pairs, tmp_path):
    plain = review.operational_review(pairs, KEYS, str(tmp_path / "a"), strategy="ontology_policy")
    assert plain.answers is None

    def broken():
        def call(texts):
            raise ConnectionError("down")
        return call

    failed = review.operational_review(pairs, KEYS, str(tmp_path / "b"), broken)
    same = ["pair_id", "field", "effective_status", "resolution_source", "reason_code"]
    assert failed.fields.select(same).exceptAll(plain.fields.select(same)).count() == 0
    assert {r.problem for r in failed.answers.collect()} == {"call_failed"}
    for bad in ({"strategy": "other"}, {}):
        with pytest.raises(ValueError):
            review.operational_review(pairs, KEYS, str(tmp_path / "c"), **bad)


# --- keyed tables ----------------------------------------------------------------------------------


def decisions(spark, rows):
    return spark.createDataFrame(rows, "run_id string, field string, decision string, note string, decided_at long")


def test_merges_touch_only_their_folders_and_may_be_replayed(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["run_id", "field"]
    fold = lambda old, new: overlay.latest_decisions(old.unionByName(new))
    schema = decisions(spark, [("r", "f", "same", None, 1)]).schema
    assert sinks.read_keyed(spark, path, schema).count() == 0
    rng, want = random.Random(1), {}
    batches = [[(f"r{rng.randrange(200)}", "f", rng.choice(["same", "different"]), str(i), b * 1000 + i) for i in range(n)] for b, n in enumerate((300, 1, 80))]
    for rows in batches:
        for r in rows:
            want[r[0]] = r
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "t").rglob("*.parquet")}
    for i, rows in enumerate(batches):
        before = files()
        for _ in range(2):  # the second time is a replay
            sinks.merge_keyed(decisions(spark, rows), path, keys, fold, slots=16)
        changed = {k for k, v in files().items() if before.get(k) != v}
        assert len(changed) == 1 if i == 1 else len(changed) > 10
        assert set(before) <= set(files())
    got = {r.run_id: tuple(r) for r in sinks.read_keyed(spark, path, schema).select(*schema.names).collect()}
    assert got == want
    sinks.merge_keyed(decisions(spark, batches[0]).limit(0), path, keys, fold, slots=16)
    assert sinks.read_keyed(spark, path, schema).count() == len(want)


def test_alias_merge_keeps_first_texts_and_takes_the_last_run(spark, tmp_path):
    path = str(tmp_path / "aliases")
    request = lambda run, left, right, at: (run, "party.trustee", "same", left, right, at)
    names = "run_id string, field string, decision string, contract_raw string, im_raw string, decided_at string"
    batches = ([request("r2", "Sun Bank", "Sun-Bank Co", "20")], [request("r1", "SUN BANK CO", "sun bank", "10"), request("r3", "Moon", "Mond", "30")])
    for rows in (*batches, batches[1]):
        accepted = overlay.alias_requests(spark.createDataFrame(rows, names)).filter("alias_outcome = 'accepted'")
        sinks.merge_keyed(overlay.as_aliases(accepted), path, list(overlay.ALIAS_KEY), overlay.combine_aliases)
    got = {r.left_norm: (r.left_raw, r.right_raw, r.source_run_id, r.created_at) for r in sinks.read_keyed(spark, path, Q.intake.ALIAS_SCHEMA).collect()}
    assert got == {"sunbank": ("Sun Bank", "Sun-Bank Co", "r1", "20"), "mond": ("Moon", "Mond", "r3", "30")}


# --- judge mode and refusals -----------------------------------------------------------------------


def test_judge_mode_quotes_the_support_case(spark, tmp_path):
    cases = own_cases(spark)
    dated = spark.createDataFrame([("m1", "fund.maturity_date", "match", "x", "hard", "설정일로부터 3년", 1, "만기는 추후 정함", 2, "own")], cases.schema)
    rows, answers = modes.judge_mode(cases.unionByName(dated), 22, 32, Q.rule_judge, str(tmp_path / "j"))
    assert rows.count() == 25 and rows.select("case_id").distinct().count() == 25
    request = json.loads(answers.filter("case_id = 'm1'").first().request)
    assert request["contract_inception_raw_text"] == "2031년 11월 28일" and request["im_inception_raw_text"] == "2031-11-28"  # the first matching case by id
    assert set(request) == {"field", "label", "contract_raw_text", "im_raw_text", "contract_inception_raw_text", "im_inception_raw_text"}
    judged = {r.case_id: r.judged for r in answers.collect()}
    for r in rows.collect():
        if judged.get(r.case_id):
            assert (r.final_status, r.final_reason_code) == ({"same": "same_after_normalization", "different": "different_after_normalization"}[judged[r.case_id]], "ontology_policy_judge")
    assert inference.support_texts(cases.limit(0)).count() == 0


def test_every_reason_of_a_refusal(spark):
    """One request a route and hash: all defects occur, each is told by its own reason, good answers have none."""
    fields = {"redeemability": "redemption_terms.is_redeemable", "maturity": "fund.maturity_date", "redemption_fee": "redemption_terms.redemption_fee", "generic": "fund.name"}
    rows = [(f"{route}{i}", field, route, json.dumps({"field": field, "label": str(i), "contract_raw_text": "a", "im_raw_text": "b"}))
            for route, field in fields.items() for i in range(1500)]
    asked = spark.createDataFrame(rows, "case_id string, field string, route string, request string")
    checked = inference.read_verdicts(inference.call_model(asked, Q.hashed_judge))
    found = {}
    for r in inference.dead_letters(checked, "case_id", "route").collect():
        found.setdefault(r.route, set()).add(r.problem)
        assert r.problem == (f"{r.kind}:{r.subject}" if r.subject else r.kind) and r.request
    assert found == {route: set(options) for route, options in Q.DEFECTS.items()}
    good = checked.filter("problem is null")
    assert {(r.route, r.judged) for r in good.collect()} == {(route, j) for route in fields for j in ("same", "different", None)} - {("generic", None)}


# --- harness modes ---------------------------------------------------------------------------------


def test_modes_of_good_and_refused_pairs(spark, pairs):
    bad = F.substring("pair_id", 2, 20).cast("bigint") % 20 == 3
    text = F.to_json("extraction", {"ignoreNullFields": "false"})
    docs = pairs.withColumn("attempts", F.array(F.when(bad, F.lit("{}")).otherwise(text)))
    rows = review.run_modes(docs, ["pair_id"]).collect()
    refused = {r.pair_id for r in pairs.filter(bad).collect()}
    for pair in {r.pair_id for r in pairs.collect()}:
        own = {m: [r for r in rows if r.pair_id == pair and r.mode == m] for m in review.MODES}
        assert len(own["baseline"]) == len(own["ontology"]) == 14 and len(own["guard"]) == (1 if pair in refused else 14)
        assert {(r.final_status, r.conforms) for r in own["baseline"]} == {(None, None)}
        assert not any(r.guard_events or r.guard_caught for r in own["baseline"] + own["ontology"])
        if pair in refused:
            r = own["guard"][0]
            assert (r.field, r.g1_fatal, r.final_status, r.conforms) == (None, True, None, None)
            assert [e.reason_code for e in r.guard_events] == ["schema_violation"]
        else:
            assert sum(e.guard == "G1" for r in own["guard"] for e in r.guard_events) == 1
            assert {r.conforms for r in own["guard"]} <= {True, False}


def test_format_guard_keeps_all_problems(spark):
    broken = json.dumps({"schema_version": "v1", **{f"extra_{i:03d}": 1 for i in range(100)}})
    df = spark.createDataFrame([("p", [broken, "[]"])], "pair_id string, attempts array<string>")
    r = guards.check_format(df, ["pair_id"]).first()
    assert len(r.violations) == 2 and len(r.violations[0]) > 100 and len(r.guard_events[0].reason) == 300
    assert "; ".join(r.violations[0]).startswith(r.guard_events[0].reason)


# --- repeated runs, sinks, reports -----------------------------------------------------------------


def test_resume_reads_pending_folders_only(spark, tmp_path):
    rows = [(t, r, float(i)) for t in ("a", "b") for r in range(4) for i in range(r + 1)]
    e = spark.createDataFrame(rows, "tier string, rep int, value double").select("value", "tier", "rep")
    sinks.write_rows(e, str(tmp_path / "in"), "tier", "rep")
    planned = e.select("tier", "rep").distinct()
    schema = T.StructType([T.StructField("n", T.LongType())])
    seen = []

    def work(df):
        seen.append({(r.tier, r.rep) for r in df.select("tier", "rep").distinct().collect()})
        return df.groupBy("tier", "rep").agg(F.count("*").alias("n"))

    first = tables.resume(spark, str(tmp_path / "in"), planned.filter("rep < 2"), str(tmp_path / "out"), schema, work)
    assert first.count() == 4
    # A finished repetition's input isn't opened: its files may even be gone.
    for name in ("tier=a/rep=0", "tier=b/rep=1"):
        for f in (tmp_path / "in" / name).glob("*.parquet"):
            f.write_bytes(b"broken")
    done = tables.resume(spark, str(tmp_path / "in"), planned, str(tmp_path / "out"), schema, work, e.schema)
    assert {(r.tier, r.rep): r.n for r in done.collect()} == {(t, r): r + 1 for t in "ab" for r in range(4)}
    assert seen == [{(t, r) for t in "ab" for r in (0, 1)}, {(t, r) for t in "ab" for r in (2, 3)}]
    again = tables.resume(spark, str(tmp_path / "in"), planned, str(tmp_path / "out"), schema, work, e.schema)
    assert again.count() == 8 and seen[2] == set()


def test_results_by_run_and_reports_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "p1", {"a": "x", "b": None}), ("r2", "p2", None)], "run_id string, pair_id string, answer map<string,string>")
    sinks.write_results(str(tmp_path), judgements=rows)
    assert sorted(p.name for p in (tmp_path / "judgements").iterdir() if p.is_dir()) == ["run_id=r1", "run_id=r2"]
    back = {r.pair_id: r.answer for r in sinks.read_results(spark, str(tmp_path), "judgements", rows.schema).collect()}
    assert back == {"p1": {"a": "x", "b": None}, "p2": None}
    fields = spark.createDataFrame([("p", 2, "c"), ("p", 0, "a"), ("p", 1, "b")], "pair_id string, ord int, field string")
    assert [r.field for r in sinks.run_report(fields, ["pair_id"], "ord", "field").first().fields] == ["a", "b", "c"]
    runs = spark.createDataFrame([("x", 7, 70), ("x", 3, 30), ("y", 1, 10)], "call string, seed int, tokens int")
    got = {r.call: (r.n_runs, r.seeds, [m.tokens for m in r.runs]) for r in sinks.run_summary(runs, "call", "seed", "tokens").collect()}
    assert got == {"x": (2, [3, 7], [30, 70]), "y": (1, [1], [10])}


def test_run_statuses_and_errors(spark):
    fields = spark.createDataFrame([("a", "match"), ("a", "needs_human_review"), ("b", "match"), ("b", "mismatch")], "run_id string, effective_status string")
    told = lambda reviewed: {r.run_id: r.status for r in overlay.run_statuses(fields, reviewed).collect()}
    assert told(False) == {"a": "awaiting_review", "b": "completed"} and told(True) == {"a": "awaiting_review", "b": "reviewed"}
    long = "e" * 5000
    r = overlay.failed_runs(spark.createDataFrame([(long,), (None,)], "error string")).orderBy(F.col("error").isNull()).collect()
    assert (len(r[0].error), r[0].error_text, r[1].error) == (1000, long, None)


def test_mean_confusion(spark):
    rows = [("t", 1, "tp", 3.0), ("t", 2, "tp", 4.0), ("t", 3, "tp", 4.0), ("t", 1, "f1", 0.5)]
    df = spark.createDataFrame(rows, "tier string, rep int, metric string, value double")
    assert [tuple(r) for r in stats.mean_confusion(df).collect()] == [("t", "tp", 3.67)]


def test_policies_from_yaml(tmp_path):
    yaml = pytest.importorskip("yaml")
    policies = {p.field: p for p in TRUST_FUND.policies}
    body = {p.field: {"label": p.label, "value_type": p.value_type, "canonicalizer": p.canonicalizer, "compare_policy": p.compare_policy,
                      "judge_allowed": p.judge_allowed, "absence_semantics": p.absence_semantics,
                      **({"range": {"min": p.range_min, "max": p.range_max}} if p.range_min is not None else {}),
                      **({"derive_from": p.derive_from} if p.derive_from else {})} for p in policies.values()}
    path = tmp_path / "policies.yaml"
    path.write_text(yaml.safe_dump(body, allow_unicode=True), encoding="utf-8")
    assert load_field_policies(path) == policies and set(SIDES) == {"contract", "im"}
    body["fund.name"]["colour"] = "red"
    path.write_text(yaml.safe_dump(body), encoding="utf-8")
    with pytest.raises(ValueError):
        load_field_policies(path)
