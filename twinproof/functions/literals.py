"""Constant lookup tables as map literals, built once per process."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=512)
def _map_literal(items: tuple) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in items) + ")")


def gather(values: list[Column], dtype: str) -> Column:
    """Array of the values that are not null, without a (never compiled) lambda."""
    empty = F.expr(f"CAST(array() AS array<{dtype}>)")
    return F.concat(*[F.when(v.isNotNull(), F.array(v)).otherwise(empty) for v in values])


def lookup(key: Column, mapping: dict) -> Column:
    """``mapping[key]``; null for other keys. The map folds to one constant."""
    return _map_literal(tuple(mapping.items()))[key]
