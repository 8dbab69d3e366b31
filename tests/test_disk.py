"""Sinks keep little on disk: JSON lines are packed, rows that lie by their folders are not moved."""

import gzip
import json

from pyspark.sql import functions as F

from twinproof.plans import workload as L
from twinproof.sources import sinks

SF = "/root/testdata/sf0.001"


def test_json_results_are_packed_and_whole(spark, tmp_path):
    """nulls stay spelt out, the files are gzip's."""
    rows = spark.createDataFrame([("r1", "p1", None), ("r2", "p2", "x"), ("r2", "p3", "y")], "run_id string, pair_id string, text string")
    for arranged in (False, True):
        path = tmp_path / str(arranged)
        held = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        sinks.write_results(str(path), arranged=arranged, kind=rows)
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == held
        files = [p for p in (path / "kind").rglob("part-*")]
        assert files and all(p.name.endswith(".json.gz") for p in files)
        lines = [json.loads(x) for p in files for x in gzip.open(p, "rt")]
        assert sorted(map(repr, lines)) == ["{'pair_id': 'p1', 'text': None}", "{'pair_id': 'p2', 'text': 'x'}", "{'pair_id': 'p3', 'text': 'y'}"]
        back = sinks.read_results(spark, str(path), "kind", rows.schema).select(rows.columns).collect()
        assert sorted(map(tuple, back), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_extractions_by_run_lie_in_few_tasks(spark, tmp_path):
    """a run is in a few shares and not in every task, and no row is lost."""
    docs = L.extractions(spark, SF, by_run=True)
    held = docs.select("run_id", F.spark_partition_id().alias("task")).groupBy("run_id").agg(F.countDistinct("task").alias("n")).agg(F.max("n")).first()[0]
    assert held <= L.RUN_SHARES
    plain = L.extractions(spark, SF)
    assert docs.exceptAll(plain).count() == 0 and docs.count() == plain.count()
    sinks.write_rows(docs.select("run_id", "pair_id"), str(tmp_path / "out"), "run_id", fmt="json", arranged=True)
    assert spark.read.json(str(tmp_path / "out")).count() == plain.count()
    assert max(len(list(p.glob("part-*"))) for p in (tmp_path / "out").iterdir() if p.is_dir()) <= L.RUN_SHARES
