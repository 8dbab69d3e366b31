"""Readers and writers that work on files."""

import json

import pytest
from pyspark.sql import functions as F

from own_cases import own_cases
from twinproof.operators import scoring
from twinproof.plans import modes
from twinproof.sources import documents, sinks, tables


def test_case_csv_refuses_another_column_order(spark, tmp_path):
    rows = own_cases(spark).withColumns({"label": F.col("field"), "category": F.lit("own"), "weak_model_pitfall": F.lit(""), "note": F.lit('a "b", c')})
    good = str(tmp_path / "good")
    rows.select(*tables.CASE_COLUMNS).coalesce(1).write.csv(good, header=True, escape='"')
    for multi_line in (True, False):
        assert tables.read_cases(spark, good, multi_line=multi_line).count() == rows.count()
    first, second = tmp_path / "mixed" / "a.csv", tmp_path / "mixed" / "b.csv"
    first.parent.mkdir()
    names = list(tables.CASE_COLUMNS)
    first.write_text(",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    second.write_text(",".join(names[::-1]) + "\n" + ",".join("2" for _ in names) + "\n")
    with pytest.raises(Exception):
        tables.read_cases(spark, str(first.parent), strict=False).collect()


def test_rep_reports_and_normalizations(spark, tmp_path):
    for tier, rep, f1 in (("t1", 1, 0.5), ("t1", 12, 0.75)):
        path = tmp_path / tier / f"rep_{rep:02d}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps({"mode": "x", "n_cases": 3, "metrics": {"f1": f1}, "confusion": {"tp": 2}}))
    got = {(r.tier, r.rep, r.metric): r.value for r in tables.read_reps(spark, f"{tmp_path}/t1/*.json").collect()}
    assert got == {("t1", 1, "f1"): 0.5, ("t1", 1, "tp"): 2.0, ("t1", 12, "f1"): 0.75, ("t1", 12, "tp"): 2.0}
    planned = spark.createDataFrame([("t1", 1), ("t1", 2)], "tier string, rep int")
    done = spark.createDataFrame([k[:2] for k in got], "tier string, rep int")
    assert [tuple(r) for r in tables.pending_reps(planned, done).collect()] == [("t1", 2)]
    run = tmp_path / "run7"
    run.mkdir()
    side = {"normalized_value": "1.5", "normalized_unit": "percent_per_year", "method": "direct"}
    (run / "normalizations.json").write_text(json.dumps([{"field": "a", "contract": side, "im": None}, {"field": "", "contract": side, "im": side}]))
    rows = {(r.run_id, r.field, r.side): r.normalized_value for r in tables.read_normalizations(spark, f"{run}/*.json").collect()}
    assert rows == {("run7", "a", "contract"): "1.5", ("run7", "a", "im"): None}


def test_files_are_checked_and_large_ones_not_loaded(spark, tmp_path):
    # Spark's reader skips files of no bytes; a content column from elsewhere may be empty.
    assert documents.check_files(spark.createDataFrame([(bytearray(),)], "content binary")).first().problem == "empty"
    for name, body in (("a.pdf", b"%PDF-1"), ("c.pdf", b"hello"), ("d.pdf", b"%PDF-" + b"x" * 100)):
        (tmp_path / name).write_bytes(body)
    rows = documents.check_files(documents.read_files(spark, str(tmp_path), max_bytes=50)).collect()
    assert {r.path.rsplit("/", 1)[-1]: r.problem for r in rows} == {"a.pdf": None, "c.pdf": "not_a_pdf", "d.pdf": "too_large"}
    pages = spark.createDataFrame([("a", "vision"), ("b", "text")], "doc_id string, source string")
    assert [r.doc_id for r in documents.vision_documents(pages).collect()] == ["a"]


def test_report_sinks(spark, tmp_path):
    parts = [scoring.classify(modes.evaluate(own_cases(spark), m, 22, 32)).withColumn("mode", F.lit(m)) for m in ("guard", "ontology_policy")]
    both = parts[0].select("mode", "case_id", "gold_label", "predicted_label").unionByName(parts[1].select("mode", "case_id", "gold_label", "predicted_label"))
    skipped = sinks.write_paired_csv(both, ["guard", "ontology_policy"], str(tmp_path / "paired"))
    assert skipped.count() == 0
    back = spark.read.csv(str(tmp_path / "paired"), header=True)
    assert back.count() == 24 and back.columns[1:] == ["gold_label", "mode_guard", "mode_ontology_policy"]
    metrics = scoring.score(parts[1], "mode").select("mode", "f1", "recall")
    report = json.loads(sinks.nested_report(parts[1], metrics).first().report)
    assert report["recall"] == pytest.approx(0.75)
    triples = spark.createDataFrame([("g", "fund_contract", "fund_name", "x", "literal", None)],
                                    "graph_id string, s string, p string, o string, o_kind string, o_datatype string")
    sinks.write_triples(triples, str(tmp_path / "nt"))
    assert spark.read.text(str(tmp_path / "nt")).count() == 1
