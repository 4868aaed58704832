"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelog.llm.frames import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``(a, b)``.

    Each round first hangs every node's larger neighbours on its least one, then the smaller
    ones; no node ever gathers its neighbours in one place, only their minimum. Rounds go on
    until the table stays as it is. An empty edge table gives an empty result.
    """
    current = scratch.store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = _fingerprint(current)
    while True:
        large = _large_star(current)
        following = scratch.store(_small_star(large), "edges")
        following_mark = _fingerprint(following)
        scratch.drop(current)
        current = following
        if following_mark == mark:
            break
        mark = following_mark
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    onto_least = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onto_least.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hashed), F.min(hashed), F.max(hashed)).first())
