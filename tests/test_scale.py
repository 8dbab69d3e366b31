"""Work that grows with the tables is dealt out, and not broadcast or cut."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinproof.operators import constraints as K
from twinproof.plans import all_queries, workload as L
from twinproof.session import DEALT_PER_CORE, LEAST_DEALT, SCAN_PARTITIONS

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_partitions(spark):
    """The session as a cluster has it: without a number of partitions for its scans."""
    held = spark.conf.get(SCAN_PARTITIONS, None)
    spark.conf.unset(SCAN_PARTITIONS)
    yield
    if held:
        spark.conf.set(SCAN_PARTITIONS, held)


@pytest.mark.parametrize("name", L.EXPANDED)
def test_expanding_tables_are_dealt_out(spark, no_partitions, name):
    """One row group is one task; its pairs and cases must not be."""
    rows = L.table(spark, SF, name)
    assert rows.rdd.getNumPartitions() == max(DEALT_PER_CORE * spark.sparkContext.defaultParallelism, LEAST_DEALT)
    assert rows.count() == spark.read.parquet(f"{SF}/{name}.parquet").count()


def test_tables_that_do_not_expand_are_left_alone(spark, no_partitions):
    for name in ("documents", "events", "customer"):
        assert L.table(spark, SF, name).rdd.getNumPartitions() == spark.read.parquet(f"{SF}/{name}.parquet").rdd.getNumPartitions()


def test_types_of_graphs_are_not_broadcast(spark, capsys):
    """the types grow with the graphs."""
    triples = K.structure_triples(spark.range(100).select(F.concat(F.lit("D"), "id").alias("pair_id")))
    broken = triples.filter(~((F.col("graph_id") == "D7") & (F.col("s") == "party_im") & (F.col("p") == K.RDF_TYPE)))
    out = K.link_class_violations(broken, infer=False)
    assert [tuple(r) for r in out.collect()] == [("D7", "fund_im", "has_party_link")]
    out.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_policy_coverage_reads_every_label(spark, tmp_path):
    """also fields that no mismatch has, and those of the pairs; here one row a table."""
    for name in L.ANCHORS:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(1).write.parquet(f"{tmp_path}/{name}.parquet")
    out = all_queries()[0]["policy_coverage"](spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {("fund.kind", "left_only"), ("fund.type", "right_only")}


@pytest.mark.parametrize(("b", "c"), [(3085, 4319), (14764, 21740)])
def test_mcnemar_of_very_different_modes(spark, b, c):
    """the tail of a large statistic is zero to six places."""
    from twinproof.operators import stats

    counts = spark.createDataFrame([(b, c, b + c)], "b bigint, c bigint, n bigint")
    assert stats.mcnemar(counts).select(F.round("p_value", 6)).first()[0] == 0.0
