"""Running counters and rates; the same functions serve batch tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelog.functions.binary import log2_bucket
from wirelog.operators.decode import classify_packets
from wirelog.operators.defrag import single_messages, with_checksum
from wirelog.operators.stats import SLOTS, packet_counters
from wirelog.schemas import DEFAULT_DISORDER
from wirelog.session import duration_us

RATE_WINDOWS = ("1 minute", "5 minutes", "15 minutes")


def stats_stream(
    packets: DataFrame, window: str | None = None, watermark_delay: str = DEFAULT_DISORDER
) -> DataFrame:
    """Counters per listener, running (update mode) or per tumbling window (append mode)."""
    classified = classify_packets(packets)
    if window is None:
        return classified.groupBy("listener").agg(*packet_counters())
    return (
        classified.withWatermark("ts", watermark_delay)
        .groupBy("listener", F.window("ts", window).alias("window"))
        .agg(*packet_counters())
    )


def rate(
    routed: DataFrame, window: str, slide: str = "1 minute", watermark_delay: str = DEFAULT_DISORDER
) -> DataFrame:
    """Messages per topic and second over sliding windows.

    Counts per ``slide`` come first and are combined before any shuffle; a sliding window
    then adds up those counts, so no message is repeated for every window it falls in.
    """
    source = routed.withWatermark("ts", watermark_delay) if routed.isStreaming else routed
    minutes = source.groupBy("topic", F.window("ts", slide).alias("slot")).agg(
        F.count(F.lit(1)).alias("messages")
    )
    seconds = duration_us(window) / 1_000_000
    wide = minutes.groupBy("topic", F.window("slot", window, slide).alias("window")).agg(
        F.sum("messages").alias("messages")
    )
    return wide.select(
        "topic",
        F.lit(window).alias("span"),
        F.col("window.start").alias("window_start"),
        "messages",
        (F.col("messages") / F.lit(seconds)).alias("per_second"),
    )


def rates(
    routed: DataFrame, windows: tuple[str, ...] = RATE_WINDOWS, slide: str = "1 minute"
) -> DataFrame:
    """:func:`rate` for several spans of a batch table."""
    return reduce(DataFrame.unionByName, [rate(routed, span, slide) for span in windows])


HISTOGRAM = "listener string, histogram string, row int, slot int, n bigint"


def health_cells(fragments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What the four histograms are made of, a row per counted thing: ``histogram``, ``row``, ``slot``, ``n``.

    ``fragments`` (by log2 of the index) come from the parsed stream, ``checksum`` (by log2 of the
    message's last index), ``invalid`` and ``dropped`` (``row`` by the message, ``slot`` by the fragment) from
    what ``defragment_stream`` or ``defragment_in_order`` gives. Stateless, for streams and tables.
    """
    last = log2_bucket(F.col("fragment_count") - 1)

    def cell(name: str, row: Column | int, slot: Column) -> Column:
        row = F.lit(row) if isinstance(row, int) else row
        place = row.cast("int").alias("row"), slot.cast("int").alias("slot")
        return F.struct(F.lit(name).alias("histogram"), *place, F.lit(1).cast("bigint").alias("n"))

    def listed(rows: DataFrame, cells: Column) -> DataFrame:
        return rows.select("listener", F.explode(cells).alias("_cell")).select("listener", "_cell.*")

    # The outcomes are read once: a stream allows one of its stateful operators per query.
    bad = with_checksum(outcomes)
    of_outcome = (
        F.when((F.col("kind") == "message") & ~F.col("checksum_ok"), F.array(cell("checksum", 0, last)))
        .when(F.col("kind") == "invalid", F.array(cell("invalid", last, log2_bucket("fragment_index"))))
        .when(F.col("kind") == "incomplete", F.transform("missing", lambda i: cell("dropped", last, log2_bucket(i))))
    )
    alone = with_checksum(single_messages(fragments.where(F.col("fragment_count") == 1)))
    parts = [
        listed(fragments, F.array(cell("fragments", 0, log2_bucket("fragment_index")))),
        listed(alone.where("not checksum_ok"), F.array(cell("checksum", 0, last))),
        listed(bad, of_outcome),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_health(cells: DataFrame, path: str, checkpoint: str):
    """A stream that adds up each micro-batch of ``health_cells`` in a folder of its own below ``path``.

    At most 17 x 17 rows a histogram and listener are written per batch; a batch that runs again
    replaces what it wrote, so nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy("listener", "histogram", "row", "slot").agg(F.sum("n").alias("n"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def health(spark: SparkSession, path: str) -> DataFrame:
    """The histograms so far: ``fragments`` and ``checksum`` dense, ``invalid`` and ``dropped`` as triangles."""
    return dense_health(spark.read.schema(f"{HISTOGRAM}, batch bigint").parquet(path))


def dense_health(cells: DataFrame) -> DataFrame:
    """Rows of ``health_cells``, or sums of them, as one row per listener."""
    summed = cells.groupBy("listener", "histogram", "row", "slot").agg(F.sum("n").alias("n"))
    cell = F.struct(F.concat("histogram", F.lit(" "), F.col("row") * SLOTS + F.col("slot")).alias("at"), "n")
    # At most 2 x 17 + 2 x 17 x 17 cells per listener.
    listed = summed.groupBy("listener").agg(F.map_from_entries(F.collect_list(cell)).alias("_cells"))

    def line(name: str, row, length) -> Column:
        at = lambda slot: F.concat(F.lit(f"{name} "), row * SLOTS + slot)
        count = lambda slot: F.coalesce(F.try_element_at("_cells", at(slot)), F.lit(0))
        return F.transform(F.sequence(F.lit(0), length), count)

    def lines(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda row: line(name, row, row))

    return listed.select(
        "listener",
        *[line(name, F.lit(0), F.lit(SLOTS - 1)).alias(name) for name in ("fragments", "checksum")],
        *[lines(name).alias(name) for name in ("invalid", "dropped")],
    )
