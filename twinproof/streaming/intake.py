"""Review intake, decision upserts and live summaries.

Whole extractions travel through the stream, one row per pair, so derivation and order
rules stay inside the row and no state is kept. Keyed state (decisions, aliases) exists only as
tables that ``foreachBatch`` merges into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions import verdicts as V
from twinproof.operators.evidence import extraction_schema
from twinproof.operators.overlay import (
    ALIAS_KEY, alias_requests, as_aliases, combine_aliases, latest_decisions, match_aliases, review_fields,
)
from twinproof.plans.review import REVIEW_COLUMNS, checked_rows, review_rows
from twinproof.profile import TRUST_FUND, Profile
from twinproof.sources.sinks import merge_keyed, read_keyed

ALIAS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (
    *ALIAS_KEY, "left_raw", "right_raw", "source_run_id", "status", "created_at")])


def extraction_stream(spark: SparkSession, path: str, profile: Profile = TRUST_FUND,
                      max_files: int = 1000) -> DataFrame:
    """Parquet files of nested extractions, as they arrive."""
    schema = f"pair_id string, contract_pages int, im_pages int, extraction {extraction_schema(profile).simpleString()}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def review_stream(extractions: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """Streaming (or batch) extractions -> review rows; stateless."""
    return review_fields(review_rows(extractions, ["pair_id"], profile))


def write_review(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_summary(rows: DataFrame) -> DataFrame:
    """Counts per run, updated as rows arrive (use output mode ``update`` or ``complete``)."""
    status = F.col("effective_status")
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status == "needs_human_review").alias("open_reviews"),
    ).withColumn("status", V.run_status(F.col("open_reviews"), F.lit(False)))


def review_with_aliases(extractions: DataFrame, alias_path: str, path: str, checkpoint: str,
                        profile: Profile = TRUST_FUND, available_now: bool = True):
    """Review a stream of extractions with the aliases approved so far.

    Every micro-batch joins the alias table as it stands when the batch starts, so a
    pair that is approved between two batches matches from the next one on. A batch's rows go to
    ``<path>/batch=<id>``; a replayed batch overwrites its own folder only.
    """

    def review(batch: DataFrame, batch_id: int) -> None:
        rows = checked_rows(review_rows(batch, ["pair_id"], profile, details=False), ["pair_id"], f"{path}-checked/batch={batch_id}")
        aliases = read_keyed(batch.sparkSession, alias_path, ALIAS_SCHEMA)
        fields = review_fields(match_aliases(rows, aliases, profile))
        fields.select("pair_id", *REVIEW_COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = extractions.writeStream.foreachBatch(review).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_aliases(requests: DataFrame, alias_path: str, checkpoint: str, profile: Profile = TRUST_FUND,
                   available_now: bool = True):
    """Merge a stream of remember-this-alias requests into the alias table."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        accepted = alias_requests(batch, profile).filter("alias_outcome = 'accepted'")
        merge_keyed(as_aliases(accepted), alias_path, list(ALIAS_KEY), combine_aliases)

    writer = requests.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_decisions(decisions: DataFrame, table_path: str, checkpoint: str, order: str = "decided_at",
                     available_now: bool = True):
    """Fold a decision stream into a last-wins table; a micro-batch touches only the folders of its keys."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_keyed(batch, table_path, ["run_id", "field"],
                    lambda stored, new: latest_decisions(stored.unionByName(new), order))

    writer = decisions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_decisions(spark: SparkSession, table_path: str, schema) -> DataFrame:
    """The latest decisions (none when there is no table)."""
    return read_keyed(spark, table_path, schema)


def drop_repeats(decisions: DataFrame, event_time: str, delay: str, *keys: str) -> DataFrame:
    """Exact repeats within the watermark; state is bounded by ``delay``."""
    return decisions.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
