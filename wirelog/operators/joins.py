"""Joins in which NULL equals NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` with NULL-safe keys; the left side's keys are kept."""
    renamed = right.select(
        *[F.col(key).alias(f"_on_{key}") for key in keys], *[c for c in right.columns if c not in keys]
    )
    same = reduce(
        lambda a, b: a & b, [left[key].eqNullSafe(renamed[f"_on_{key}"]) for key in keys]
    )
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_on_{key}" for key in keys])
