"""Distributions that merge: a sketch per listener and window, stored, and added up later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.schemas import DEFAULT_DISORDER

#: Size of a sketch, and how far the rank of a value that it names may lie from the rank asked for
#: (the published bound at this size, 99 % sure). A merged sketch has the bound of one.
SKETCH_SIZE = 800
RANK_ERROR = 0.005
POINTS = (0.5, 0.75, 0.95, 0.99)


def size_sketches(
    df: DataFrame, size: Column, by: tuple[str, ...] = ("listener",), window: str | None = None,
    watermark_delay: str = DEFAULT_DISORDER,
) -> DataFrame:
    """One sketch of ``size`` per group (and tumbling ``window``), with count, bounds and sum.

    Some kilobytes per group whatever its rows; combined before the shuffle. On a stream give a window:
    its sketches leave when the watermark has passed it. Null sizes are left out.
    """
    rows = df.withColumn("_size", size.cast("bigint")).where("_size is not null")
    groups: list = list(by)
    if window is not None:
        rows = rows.withWatermark("ts", watermark_delay) if rows.isStreaming else rows
        groups.append(F.window("ts", window).alias("window"))
    return rows.groupBy(*groups).agg(
        F.kll_sketch_agg_bigint("_size", SKETCH_SIZE).alias("sketch"),
        F.count(F.lit(1)).alias("n"),
        F.min("_size").alias("smallest"),
        F.max("_size").alias("largest"),
        F.sum("_size").alias("total"),
    )


def merge_sketches(sketches: DataFrame, by: tuple[str, ...] = ("listener",)) -> DataFrame:
    """Sketches of ``size_sketches`` added up: any windows, days or captures of a group."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_bigint("sketch", SKETCH_SIZE).alias("sketch"),
        F.sum("n").alias("n"),
        F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
        F.sum("total").alias("total"),
    )


def profile_of(sketches: DataFrame) -> DataFrame:
    """The columns of ``size_profile`` that a sketch can give: exact ones, mean, and quantiles within ``RANK_ERROR``."""
    points = [
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(f"p{int(p * 100)}") for p in POINTS
    ]
    return sketches.withColumn("mean", F.col("total") / F.col("n")).select("*", *points).drop("sketch")
