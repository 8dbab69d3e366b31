"""Writers: reports, paired labels, manifests, triples, keyed tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.operators.constraints import triple_lines
from twinproof.operators.stats import align_modes, skipped_cases


def paired_labels(cases: DataFrame, modes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``case_id, gold_label, mode_*`` rows, skipped case ids) for a paired-label table."""
    wide = align_modes(cases, modes, "predicted_label")
    gold = cases.filter(F.col("mode") == modes[0]).groupBy("case_id").agg(F.max("gold_label").alias("gold_label"))
    table = gold.join(wide, "case_id").select("case_id", "gold_label", *[f"mode_{m}" for m in modes])
    return table, skipped_cases(cases, modes)


def write_paired_csv(cases: DataFrame, modes: list[str], path: str) -> DataFrame:
    """Write the paired table as CSV parts with a header; returns the skipped ids.

    The header's first cell carries the UTF-8 mark that spreadsheet programs look for.
    """
    table, skipped = paired_labels(cases, modes)
    table.withColumnRenamed("case_id", "﻿case_id").write.mode("overwrite").csv(path, header=True)
    return skipped


#: Rows a compressed JSON file holds at most: no reader can split it.
FILE_ROWS = 250_000
#: Folders a task writes side by side before it sorts the rest of its rows by folder.
OPEN_FILES = 64


def _append(df: DataFrame, path: str, by: tuple[str, ...], fmt: str, arranged: bool) -> None:
    """Append rows below ``path`` in a folder a value of ``by``; JSON lines are packed by gzip.

    Rows that are ``arranged`` stay in their tasks: nothing wide is shuffled, and as JSON nothing is sorted.
    """
    writer = (df if arranged else df.hint("rebalance", *by)).write.mode("append").partitionBy(*by)
    if fmt != "json":
        writer.format(fmt).save(path)
        return
    spark, key = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    held = spark.conf.get(key)
    spark.conf.set(key, str(OPEN_FILES if arranged else held))
    try:
        writer.options(ignoreNullFields="false", compression="gzip", maxRecordsPerFile=FILE_ROWS).json(path)
    finally:
        spark.conf.set(key, held)


def write_rows(df: DataFrame, path: str, *partitions: str, fmt: str = "parquet", arranged: bool = False) -> None:
    """Report rows partitioned by run keys.

    Rows are brought together by their keys first, so a run has a few files of even size and not one
    from every task; a run with very many rows is split over tasks at run time. ``arranged`` rows lie so already (dealt out by
    their keys while they were narrow, or keys with few values) and are not moved.
    """
    _append(df, path, partitions, fmt, arranged)


def write_results(path: str, by: str = "run_id", arranged: bool = False, **results: DataFrame) -> None:
    """Result lists as JSON lines, a folder a kind and run: ``<path>/<kind>/<by>=.../``.

    Nested columns (sides, canonical values, answers) stay nested; nulls are spelt out. ``arranged`` as in ``write_rows``.
    """
    for kind, rows in results.items():
        _append(rows, f"{path}/{kind}", (by,), "json", arranged)


def read_results(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """One kind of ``write_results`` with the schema it was written with."""
    return spark.read.schema(schema).json(f"{path}/{kind}")


def run_report(fields: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """One row a key with its field rows as an array in the order of ``order``.

    The array has one entry a field of the profile, so its size is bounded by configuration.
    """
    entry = F.struct(order, *columns)
    held = fields.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("fields"))
    return held.withColumn("fields", F.transform("fields", lambda e: F.struct(*[e[c].alias(c) for c in columns])))


def run_summary(metas: DataFrame, by: str, seed: str, *columns: str) -> DataFrame:
    """A pipeline's summary a group: number of runs, their seeds and their metas, in the order of the seeds.

    One aggregation; a group holds the runs of one pipeline call (its list of seeds), not rows of data.
    """
    meta = F.struct(F.col(seed).alias("seed"), *columns)
    held = metas.groupBy(by).agg(F.count(F.lit(1)).alias("n_runs"), F.array_sort(F.collect_list(meta)).alias("runs"))
    return held.withColumn("seeds", F.transform("runs", lambda r: r["seed"]))


def nested_report(scored_cases: DataFrame, metrics: DataFrame, key: str = "mode") -> DataFrame:
    """One JSON-ready row per mode: the metric columns as a struct. Cases stay in their own table."""
    body = F.struct(*[c for c in metrics.columns if c != key])
    return metrics.select(key, F.to_json(body).alias("report"))


def manifest(runs: DataFrame) -> DataFrame:
    """Run metadata rows: latency to 3 places, cost to 6, guard toggles as one struct."""
    guards = F.struct("g1_format", "g2_citation", "g3_constraint")
    return runs.select(
        F.lit("v0").alias("schema_version"), "run_id", "mode", guards.alias("guards"), "started_at", "ended_at",
        F.round("total_latency_s", 3).alias("total_latency_s"), "llm_call_count", "llm_total_tokens",
        F.round("cost_usd", 6).alias("cost_usd"))


def run_rollup(manifests: DataFrame, *keys: str) -> DataFrame:
    """Totals over run manifests: count, latency, tokens, cost."""
    return manifests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("total_latency_s").alias("total_latency_s"),
        F.sum("llm_call_count").cast("bigint").alias("llm_calls"),
        F.sum("llm_total_tokens").cast("bigint").alias("llm_tokens"), F.sum("cost_usd").alias("cost_usd"))


# --- keyed tables ---------------------------------------------------------------------------------

#: Folder column of keyed tables.
SLOT = "slot"


def _with_slot(df: DataFrame, keys: list[str], slots: int) -> DataFrame:
    return df.withColumn(SLOT, F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, only: list[int] | None = None) -> DataFrame:
    """The rows of a keyed table (of the folders ``only``); none where there is no table yet."""
    whole = T.StructType([*schema.fields, T.StructField(SLOT, T.IntegerType())])
    try:
        rows = spark.read.schema(whole).parquet(path)
        return (rows if only is None else rows.filter(F.col(SLOT).isin(only))).drop(SLOT)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merge_keyed(batch: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame],
                slots: int = 64) -> None:
    """Merge a batch into a Parquet table that has its rows in ``slots`` folders by a hash of ``keys``.

    ``merge(stored, batch)`` gives the new rows of the keys it is handed. Only the folders of the batch's keys
    are read and replaced, so the work follows the batch and not the table's age; ``slots`` stays the same for
    a table's lifetime. The merged rows are staged first, because a folder can't be replaced
    while it is read. ``merge`` must give the same rows if it meets a batch again: a replayed
    batch then mends whatever an interrupted one left.
    """
    spark, stage = batch.sparkSession, f"{path.rstrip('/')}-stage/{uuid.uuid4().hex}"
    _with_slot(batch, keys, slots).write.parquet(f"{stage}/batch")
    new = spark.read.parquet(f"{stage}/batch")
    touched = [r[0] for r in new.select(SLOT).distinct().collect()]  # at most ``slots`` numbers
    if not touched:
        return
    schema = T.StructType([f for f in new.schema.fields if f.name != SLOT])
    stored = read_keyed(spark, path, schema, touched)
    merged = _with_slot(merge(stored, new.drop(SLOT)).select(*schema.names), keys, slots)
    merged.repartition(SLOT).write.partitionBy(SLOT).parquet(f"{stage}/merged")
    spark.read.schema(new.schema).parquet(f"{stage}/merged").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """N-Triples text parts."""
    triple_lines(triples).write.mode("overwrite").text(path)
