"""Missing message ids per sender, from the whole id set or in arrival order.

Input ``ids``: one row per new message (sender columns, ``msg_id``, ``ts``, ``seq``). No
operator here brings a sender together in one task: a sender may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelog.operators.defrag import is_complete
from wirelog.operators.fragment_status import time_bucket
from wirelog.operators.id_scan import scan_ids
from wirelog.schemas import (
    DEFAULT_IDLE,
    DEFAULT_IDS_PER_PORT,
    DEFAULT_MAX_HOLE,
    SENDER,
)
from wirelog.session import duration_us

ID_BUCKET = 4096


def _check(max_hole: int) -> None:
    if max_hole < 1:
        raise ValueError(f"max_hole must be at least 1, not {max_hole}")


def new_message_ids(fragments: DataFrame, generations: DataFrame) -> DataFrame:
    """The ids a detector sees: every single-fragment packet, before its checksum, and the
    first fragment of every generation of a multi-fragment message."""
    single = fragments.where(F.col("fragment_count") == 1)
    multi = generations.withColumn("ts", F.col("first_ts")).withColumn(
        "seq", F.col("first_seq")
    )
    columns = [*SENDER, "msg_id", "ts", "seq"]
    return single.select(*columns).unionByName(multi.select(*columns))


def _small_holes(gaps: Column, max_hole: int) -> Column:
    return F.filter(gaps, lambda gap: gap["hole_size"].between(1, max_hole))


def _gap(after: Column, before: Column) -> Column:
    size = before.cast("bigint") - after.cast("bigint") - 1
    return F.struct(
        after.alias("after_id"), before.alias("before_id"), size.alias("hole_size")
    )


def gaps_exact(
    ids: DataFrame, max_hole: int = DEFAULT_MAX_HOLE, bucket: int = ID_BUCKET
) -> DataFrame:
    """Runs of missing ids between neighbours, up to ``max_hole`` long.

    Ids are cut in buckets of ``bucket`` values. A bucket's set of ids is built before the
    shuffle, so neither a busy sender nor many copies of an id make a group larger than
    that. Holes across buckets come from the second shuffle: four narrow columns per used
    bucket, at most 2^32 / ``bucket`` rows per sender. Holes inside a bucket stay where they are.
    """
    _check(max_hole)
    whole = F.col("msg_id").cast("bigint")
    present = (
        ids.select(*SENDER, "msg_id", (whole - F.pmod(whole, F.lit(bucket))).alias("_bucket"))
        .groupBy(*SENDER, "_bucket")
        .agg(F.array_sort(F.collect_set("msg_id")).alias("_ids"))
    )
    neighbours = F.transform("_ids", lambda x, at: _gap(x, F.get(F.col("_ids"), at + 1)))
    inside = present.select(*SENDER, F.explode(_small_holes(neighbours, max_hole)).alias("_gap"))
    following = F.lead("_first").over(Window.partitionBy(*SENDER).orderBy("_bucket"))
    ends = ids.select(*SENDER, "msg_id", (whole - F.pmod(whole, F.lit(bucket))).alias("_bucket"))
    across = (
        ends.groupBy(*SENDER, "_bucket")
        .agg(F.min("msg_id").alias("_first"), F.max("msg_id").alias("_last"))
        .select(*SENDER, _gap(F.col("_last"), following).alias("_gap"))
        .where(F.col("_gap.hole_size").between(1, max_hole))
    )
    return inside.unionByName(across).select(*SENDER, "_gap.*")


def sender_leases(ids: DataFrame, idle: str = DEFAULT_IDLE) -> DataFrame:
    """Stretches of a sender's activity that ``idle`` without a message ends.

    Two arrivals in one bucket of width ``idle`` cannot be that far apart, so a lease is a
    run of buckets: one row per (sender, bucket), combined before the shuffle, replaces the
    arrivals, and no window sees more rows than there are buckets in the capture.
    """
    width = duration_us(idle)
    buckets = (
        ids.withColumn("_bucket", time_bucket(width))
        .groupBy(*SENDER, "_bucket")
        .agg(
            F.min("ts").alias("_from"),
            F.max("ts").alias("_to"),
            F.count(F.lit(1)).alias("_messages"),
        )
    )
    in_time = Window.partitionBy(*SENDER).orderBy("_bucket")
    gap = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(in_time))
    return (
        buckets.withColumn("_starts", F.coalesce(gap >= width, F.lit(True)).cast("int"))
        .withColumn("lease", F.sum("_starts").over(in_time) - 1)
        .groupBy(*SENDER, "lease")
        .agg(
            F.min("_from").alias("first_ts"),
            F.max("_to").alias("last_ts"),
            F.sum("_messages").alias("messages"),
        )
    )


def id_epochs(
    ids: DataFrame, idle: str = DEFAULT_IDLE, max_hole: int = DEFAULT_MAX_HOLE
) -> DataFrame:
    """Number the stretches between port reuses: a jump of more than ``max_hole`` outside
    the ids seen since the last jump, in arrival order, starts a new one."""
    _check(max_hole)
    return (
        scan_ids(ids, idle, 1, max_hole).where("kind = 'arrival'").drop("kind", "holes")
    )


def gaps_online(
    ids: DataFrame,
    idle: str = DEFAULT_IDLE,
    ids_per_port: int = DEFAULT_IDS_PER_PORT,
    max_hole: int = DEFAULT_MAX_HOLE,
) -> DataFrame:
    """Holes as the low-latency detector reports them: an arrival that pushes the smallest
    of the ``ids_per_port`` remembered ids out counts the hole above the pushed-out id.
    Depends on arrival order; :func:`gaps_exact` gives the true loss."""
    _check(max_hole)
    found = scan_ids(ids, idle, ids_per_port, max_hole, every_arrival=False)
    return found.where("kind = 'arrival' and holes > 0").drop("kind")


def gaps_at_expiry(
    ids: DataFrame,
    idle: str = DEFAULT_IDLE,
    ids_per_port: int = DEFAULT_IDS_PER_PORT,
    max_hole: int = DEFAULT_MAX_HOLE,
) -> DataFrame:
    """Holes still remembered when a sender's lease ends; counted apart from the others."""
    _check(max_hole)
    found = scan_ids(ids, idle, ids_per_port, max_hole, every_arrival=False)
    return found.where("kind = 'lease_end' and holes > 0").select(*SENDER, "lease", "holes")


def top_ids(ids: DataFrame, n: int = DEFAULT_IDS_PER_PORT) -> DataFrame:
    """The ``n`` largest distinct ids per sender. Spark keeps at most ``n`` per sender and
    task before the shuffle (window group limit)."""
    largest = Window.partitionBy(*SENDER).orderBy(F.col("msg_id").desc())
    distinct = ids.select(*SENDER, "msg_id").distinct()
    return distinct.withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= n)


def loss_report(gaps: DataFrame, generations: DataFrame) -> DataFrame:
    """Missing ids and missing fragments per sender; both sides are aggregated first.

    The two are stacked and summed rather than joined, so a NULL in a sender is one value.
    """
    holes = gaps.groupBy(*SENDER).agg(
        F.count(F.lit(1)).alias("holes"), F.sum("hole_size").alias("missing_ids")
    )
    missing = F.col("first_header.fragment_count") - F.col("received")
    partial = (
        generations.where(~is_complete())
        .groupBy(*SENDER)
        .agg(
            F.count(F.lit(1)).alias("incomplete_messages"),
            F.sum(missing).alias("missing_fragments"),
        )
    )
    counts = ["holes", "missing_ids", "incomplete_messages", "missing_fragments"]
    both = holes.unionByName(partial, allowMissingColumns=True)
    return both.groupBy(*SENDER).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts]
    )
