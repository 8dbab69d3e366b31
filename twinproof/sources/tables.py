"""Readers for case tables and run reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.text import strip
from twinproof.operators.evidence import extraction_schema
from twinproof.profile import TRUST_FUND, Profile
from twinproof.session import MAX_DIM_ROWS

# Columns of a case table.
CASE_COLUMNS = ("case_id", "category", "field", "label", "gold_label", "mutation_type", "difficulty",
                "contract_raw", "contract_page", "im_raw", "im_page", "harness_signal",
                "weak_model_pitfall", "note")
GOLD_LABELS = ("match", "mismatch", "missing")


def _clean(name: str) -> Column:
    return F.nullif(strip(F.col(name)), F.lit(""))


def clean_cases(raw: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """Typed cases from an all-string table, with a ``problems`` list instead of exceptions."""
    missing = [c for c in CASE_COLUMNS if c not in raw.columns and c != "note"]
    if missing:
        raise ValueError(f"case table lacks columns: {missing}")
    if "note" not in raw.columns:
        raw = raw.withColumn("note", F.lit(None).cast("string"))
    nullable = ("contract_raw", "im_raw", "contract_page", "im_page")
    staged = raw.select(*[
        _clean(c).alias(c) if c in nullable else F.coalesce(_clean(c), F.lit("")).alias(c) for c in CASE_COLUMNS
    ])
    pages = [F.when(F.col(c).isNotNull() & F.col(c).try_cast("int").isNull(), F.lit(f"bad_page:{c}"))
             for c in ("contract_page", "im_page")]
    problems = F.array_compact(F.array(
        F.when(~F.col("field").isin(*profile.fields), F.lit("unknown_field")),
        F.when(~F.col("gold_label").isin(*GOLD_LABELS), F.lit("bad_gold_label")), *pages))
    return staged.withColumn("problems", problems).withColumns({
        "contract_page": F.col("contract_page").try_cast("int"), "im_page": F.col("im_page").try_cast("int")})


def read_cases(spark: SparkSession, path: str, profile: Profile = TRUST_FUND, strict: bool = True,
               multi_line: bool = True) -> DataFrame:
    """Case CSV: BOM, quotes and line breaks inside cells are handled by the reader.

    Columns are matched by the header's names: a file with another order of columns is refused
    by the reader. Line breaks inside cells need one task per file; without them
    ``multi_line=False`` lets files split.

    With ``strict`` a table with any bad row is refused (the check reports only a few rows).
    """
    header = spark.read.option("header", True).option("multiLine", multi_line).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, quote='"', escape='"', enforceSchema=False)
    cases = clean_cases(raw, profile)
    if strict:
        bad = cases.filter(F.size("problems") > 0).select("case_id", "field", "problems").take(5)
        if bad:
            raise ValueError(f"bad case rows, for example: {[tuple(r) for r in bad]}")
        return cases.drop("problems")
    return cases


def _from_path(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def read_extractions(spark: SparkSession, path: str, profile: Profile = TRUST_FUND,
                     multi_line: bool = True) -> DataFrame:
    """Extraction JSON files under run folders: ``run_id`` is the folder's name.

    One pretty-printed document per file by default; JSON lines files (``multi_line=False``)
    split and are the form to keep at scale.
    """
    nested = spark.read.schema(extraction_schema(profile)).option("multiLine", multi_line).json(path)
    body = F.struct(*[F.col(f.name) for f in extraction_schema(profile)])
    return nested.select(_from_path(r"([^/]+)/[^/]+$").alias("run_id"), body.alias("extraction"))


METRICS = ("f2", "efficiency_index_pct", "precision", "recall", "f1", "accuracy")
CONFUSION = ("tp", "fp", "fn", "tn")


def _report_schema() -> T.StructType:
    metrics = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])
    counts = T.StructType([T.StructField(c, T.LongType()) for c in CONFUSION])
    return T.StructType([T.StructField("mode", T.StringType()), T.StructField("n_cases", T.LongType()),
                         T.StructField("metrics", metrics), T.StructField("confusion", counts)])


def read_reps(spark: SparkSession, path: str) -> DataFrame:
    """Repeated-run reports ``<tier>/rep_<n>.json`` -> long ``tier, rep, metric, value``."""
    wide = spark.read.schema(_report_schema()).option("multiLine", True).json(path).select(
        _from_path(r"([^/]+)/rep_[^/]*$").alias("tier"),
        _from_path(r"rep_0*([0-9]+)\.json$").try_cast("int").alias("rep"), "metrics", "confusion")
    return long_metrics(wide)


def long_metrics(wide: DataFrame) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"metrics.{m}").alias("value")) for m in METRICS],
        *[F.struct(F.lit(c).alias("metric"), F.col(f"confusion.{c}").cast("double").alias("value")) for c in CONFUSION])
    return wide.select("tier", "rep", F.explode(pairs).alias("m")).select("tier", "rep", "m.*").filter(
        F.col("value").isNotNull())


def read_normalizations(spark: SparkSession, path: str) -> DataFrame:
    """Normalization result lists -> one row per (run, field, side)."""
    side = "struct<normalized_value:string,normalized_unit:string,method:string>"
    rows = spark.read.schema(f"field string, contract {side}, im {side}").option("multiLine", True).json(path)
    halves = F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"{s}.normalized_value").alias("normalized_value"),
                 F.col(f"{s}.normalized_unit").alias("normalized_unit")) for s in ("contract", "im")])
    return rows.filter(F.coalesce("field", F.lit("")) != "").select(
        _from_path(r"([^/]+)/[^/]+$").alias("run_id"), "field", F.explode(halves).alias("h")).select(
        "run_id", "field", "h.*")


def pending_reps(planned: DataFrame, finished: DataFrame) -> DataFrame:
    """Planned (tier, rep) rows without a finished report: resuming is an anti-join."""
    return planned.join(finished.select("tier", "rep").distinct(), ["tier", "rep"], "left_anti")


def read_pending(spark: SparkSession, path: str, planned: DataFrame, finished: DataFrame,
                 schema: T.StructType | None = None) -> DataFrame:
    """Rows of the pending (tier, rep) of a table that is partitioned by them.

    A plan is configuration (some tiers by some repetitions): up to MAX_DIM_ROWS pending keys become a filter on
    the folders, so finished repetitions aren't opened; a larger plan is joined. Without ``schema``
    one file is opened to infer it.
    """
    rows = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    pending = pending_reps(planned, finished)
    keys = pending.select("tier", "rep").take(MAX_DIM_ROWS + 1)
    if len(keys) > MAX_DIM_ROWS:
        return rows.join(pending, ["tier", "rep"])
    wanted = F.lit(False)
    for tier in sorted({k.tier for k in keys}):
        wanted = wanted | ((F.col("tier") == tier) & F.col("rep").isin([k.rep for k in keys if k.tier == tier]))
    return rows.filter(wanted)


def resume(spark: SparkSession, path: str, planned: DataFrame, results: str, schema: T.StructType,
           work: Callable[[DataFrame], DataFrame], source: T.StructType | None = None) -> DataFrame:
    """Run ``work`` on the repetitions without a result, add its rows to ``results`` and return all of them.

    ``work`` keeps ``tier`` and ``rep``; ``schema`` is that of its other columns and ``source`` that of the input. Results are partitioned like the
    input; a repetition counts as finished once its folder has rows, which one append of a job's output gives
    together. A stopped run is resumed by calling this again.
    """
    whole = T.StructType([*schema.fields, T.StructField("tier", T.StringType()), T.StructField("rep", T.IntegerType())])

    def stored() -> DataFrame:
        try:
            return spark.read.schema(whole).parquet(results)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], whole)

    done = work(read_pending(spark, path, planned, stored(), source))
    done.select(*schema.names, F.col("tier").cast("string"), F.col("rep").cast("int")).hint("rebalance", "tier", "rep").write.mode(
        "append").partitionBy("tier", "rep").parquet(results)
    return stored()
