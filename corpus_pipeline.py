"""A training-corpus pipeline over documents: five stages, each written and read again.

Each stage works on all that its predecessor kept: quality rules drop rejected documents, line
dedup rewrites texts, near-dedup keeps one document of each group, decontamination drops
documents that contain test items, and the last stage encodes what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.llm import bpe, decontaminate, linededup, quality, queries, simhash
from twinproof.llm.common import packed, shared_folder, table, unpacked
from twinproof.session import ship_package


def _joined(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text hash) is among ``verdicts``, or isn't."""
    rows = packed(docs, doc_id="doc_id", text="text").withColumn("key", F.xxhash64("text"))
    told = verdicts.select(F.col("doc_id").alias("id"), F.col("key").alias("hash"))
    return unpacked(rows.join(told, rows.doc_id.eqNullSafe(told.id) & (rows.key == told.hash), how), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs, key=True)
    return _joined(docs, judged.filter("kept"), "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = cleaned.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(kind))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), key=True)
    return _joined(docs, found.filter("contaminated"), "left_anti")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.encode(docs, queries.tokenizer_path(), ids=False, decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Fingerprints, robust estimates and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
