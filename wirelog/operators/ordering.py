"""Numbering rows in order within keys, when one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelog.session import cut_lineage


def sorted_runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partition by key *and* order, sort, and pin the layout.

    A hot key is cut into several partitions, because the ranges include the order columns.
    Adds ``part``, increasing with the range. The reliable checkpoint pins which row is in
    which partition: range bounds come from a sample and a recomputed stage might place
    them differently, while later passes must agree on them.
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return cut_lineage(placed.withColumn("part", F.spark_partition_id()))


def with_rank(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``row_number`` per key without bringing a key together in one task.

    In a pinned layout the row's offset in its partition is free. The rank follows from the
    offset at which the key's run begins there and from the key's rows in earlier
    partitions: one small row per (partition, key), counted before any shuffle.
    """
    offset = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    pinned = sorted_runs(df, keys, order).withColumn("_offset", offset)
    runs = pinned.groupBy("part", *keys).agg(
        F.min("_offset").alias("_start"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    named = runs.select(
        F.col("part").alias("_part"),
        *[F.col(key).alias(f"_{key}") for key in keys],
        (F.col("_before") - F.col("_start") + 1).alias("_shift"),
    )
    same_run = F.col("part") == F.col("_part")
    for key in keys:
        same_run = same_run & F.col(key).eqNullSafe(F.col(f"_{key}"))
    rank = F.col("_offset") + F.col("_shift")
    return pinned.join(named, same_run, "left").select(*df.columns, rank.alias(out))
