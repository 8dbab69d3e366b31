"""Registered queries and their SQL restatements."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.session import configure, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL when there is one."""

    def wrap(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(configure(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return wrap


def rounded(column: str | Column, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


def round_all(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})
