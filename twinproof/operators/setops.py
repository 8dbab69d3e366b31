"""Set comparisons used as completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, tagged; empty means the sets are equal.

    One aggregation over tagged rows compares both directions at once, and duplicates
    combine before the shuffle.
    """
    columns = left.columns
    rows = left.withColumn("_l", F.lit(True)).withColumn("_r", F.lit(False)).unionByName(
        right.select(*columns).withColumn("_l", F.lit(False)).withColumn("_r", F.lit(True)))
    seen = rows.groupBy(*columns).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return seen.filter(F.col("_l") != F.col("_r")).withColumn(
        "side", F.when(F.col("_l"), F.lit("left_only")).otherwise(F.lit("right_only"))).drop("_l", "_r")


def common_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on both sides, each once."""
    rows = left.select(key).withColumn("_l", F.lit(1)).unionByName(right.select(key).withColumn("_l", F.lit(2)))
    seen = rows.groupBy(key).agg(F.min("_l").alias("a"), F.max("_l").alias("b"))
    return seen.filter((F.col("a") == 1) & (F.col("b") == 2)).select(key)
