"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words in most contracts here: space and the five ASCII controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, name: str) -> int:
    """Position of a column: the exact name first, else the one name that differs in case only."""
    same = [i for i, c in enumerate(df.columns) if c == name] or [
        i for i, c in enumerate(df.columns) if c.lower() == name.lower()
    ]
    if not same:
        raise ValueError(f"no column {name} among {df.columns}")
    return same[0]


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, as ``new=old``; other columns may have any names, also clashing ones."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{pick(df, old)}").alias(new) for new, old in wanted.items()])


def packed(df: DataFrame, **wanted: str) -> DataFrame:
    """The whole row as struct ``row`` (fields c0, c1, ...) beside the wanted columns."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names).select(
        F.struct(*names).alias("row"), *[F.col(f"c{pick(df, old)}").alias(new) for new, old in wanted.items()]
    )


def unpacked(df: DataFrame, like: DataFrame, **replaced: Column) -> DataFrame:
    """The rows of ``packed`` again, under the names of ``like``, some columns replaced."""
    at = {pick(like, name): value for name, value in replaced.items()}
    return df.select(*[at.get(i, F.col(f"row.c{i}")).alias(f"c{i}") for i in range(len(like.columns))]).toDF(*like.columns)


def text_key(text: Column) -> Column:
    """A 128-bit key of a text, as two longs; null has its own key."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session (tests) that leaves it unset gets a temporary folder; on a cluster
    the setting is required.
    """
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


_KEPT: dict = {}


def once(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once a Python worker and ``key`` and not once a task; the last four are kept."""
    if key not in _KEPT:
        while len(_KEPT) > 3:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = make()
    return _KEPT[key]
