"""Health counters and log2 histograms. All combine before the shuffle, so that a listener
with most of the packets costs its tasks a handful of rows each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.functions.binary import i32, log2_bucket, slice_bytes, u16, utf8_text
from wirelog.operators.decode import classify_packets
from wirelog.operators.defrag import is_complete
from wirelog.operators.routing import DISCARDED_TOPIC
from wirelog.schemas import KNOWN_COMMANDS

SLOTS = 17  # log2 buckets of 16-bit numbers


def packet_counters() -> list[Column]:
    """Counters that one pass over classified packets yields."""
    size = F.octet_length("data")
    kind = F.col("kind")
    word = F.upper(utf8_text(slice_bytes("data", 2, 4)))
    counted_words = [w for w in KNOWN_COMMANDS if w != "KILL"]
    command = (kind == "command") & (size >= 6)
    fragment = kind == "fragment"
    bad_header = (
        (size < 24)
        | (u16("data", 2) == 0)
        | (u16("data", 4) >= u16("data", 2))
        | (i32("data", 12) < 0)
    )
    overrun = F.coalesce(u16("data", 20) > size - 24, F.lit(False))
    bad_header = F.coalesce(bad_header, F.lit(False))
    return [
        F.count_if(kind == "simple").alias("udp_simple_messages"),
        F.count_if(kind == "invalid_version").alias("udp_invalid_version"),
        F.count_if(kind == "invalid_type").alias("v0_invalid_type"),
        F.count_if(fragment & bad_header).alias("v0_invalid_multipart_header"),
        F.count_if(
            (kind == "command") & ((size < 6) | ~word.isin(KNOWN_COMMANDS))
        ).alias("unknown_command"),
        F.count_if(command & word.isin(counted_words)).alias("v0_commands"),
        F.count_if(
            (kind == "decode_error") | (fragment & ~bad_header & overrun)
        ).alias("exceptions"),
        F.count_if(fragment & ~bad_header & ~overrun).alias("v0_multipart_fragments"),
    ]


def counters(packets: DataFrame) -> DataFrame:
    """Scalar counters per listener, in one pass. KILL is not counted: it ends a server
    before its counter moves."""
    return classify_packets(packets).groupBy("listener").agg(*packet_counters())


def slots(bucket: Column, condition: Column | None = None) -> Column:
    """A dense 17-slot histogram as one aggregate expression."""
    hits = F.lit(True) if condition is None else condition
    return F.array(*[F.count_if(hits & (bucket == slot)) for slot in range(SLOTS)])


def fragment_index_histogram(fragments: DataFrame) -> DataFrame:
    """Fragments with a readable header per log2 of their index, dense."""
    bucket = log2_bucket("fragment_index")
    return fragments.groupBy("listener").agg(slots(bucket).alias("histogram"))


def checksum_histogram(checked: DataFrame) -> DataFrame:
    """Messages with a wrong checksum per log2 of (fragment count - 1), dense."""
    bucket = log2_bucket(F.col("fragment_count") - 1)
    return checked.groupBy("listener").agg(
        slots(bucket, ~F.col("checksum_ok")).alias("histogram")
    )


def loss_histogram_2d(fragments: DataFrame, count: Column | str = "fragment_count") -> DataFrame:
    """Long form of the two-dimensional histogram of invalid or missing fragments: row is
    log2 of (message's fragment count - 1), column is log2 of the index. Complete, also
    right of the diagonal."""
    count = F.col(count) if isinstance(count, str) else count
    return fragments.groupBy(
        "listener",
        log2_bucket(count - 1).alias("count_log2"),
        log2_bucket("fragment_index").alias("index_log2"),
    ).agg(F.count(F.lit(1)).alias("fragments"))


def triangle(histogram: DataFrame) -> DataFrame:
    """Rendering of the long form per listener: 17 rows, row i with i+1 cells."""
    cell = F.struct(
        (F.col("count_log2") * SLOTS + F.col("index_log2")).alias("cell"), "fragments"
    )
    # At most 17 x 17 cells per listener.
    cells = F.map_from_entries(F.collect_list(cell))

    def line(row: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), row),
            lambda column: F.coalesce(
                F.try_element_at(F.col("_cells"), row * SLOTS + column), F.lit(0)
            ),
        )

    return (
        histogram.groupBy("listener")
        .agg(cells.alias("_cells"))
        .select(
            "listener",
            F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), line).alias("histogram"),
        )
    )


def invalid_histogram(invalid: DataFrame) -> DataFrame:
    return loss_histogram_2d(invalid, F.col("first_header.fragment_count"))


def dropped_histogram(generations: DataFrame) -> DataFrame:
    """Histogram of fragments that never came, straight from the incomplete generations."""
    count = F.col("first_header.fragment_count")
    # What is missing in a cell is its width below the count less what arrived in it.
    bounds = F.array(*[F.lit(0)] + [F.lit(1 << slot) for slot in range(SLOTS)])
    width = lambda slot: F.greatest(
        F.least(count, F.get(bounds, slot + 1)) - F.get(bounds, slot), F.lit(0)
    )
    arrived = F.transform("indices", lambda i: log2_bucket(i))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)),
        lambda slot: F.struct(
            slot.alias("index_log2"),
            (width(slot) - F.size(F.filter(arrived, lambda a: a == slot))).cast("bigint").alias("missing"),
        ),
    )
    lost = generations.where(~is_complete()).select(
        "listener", log2_bucket(count - 1).alias("count_log2"), F.explode(cells).alias("_cell")
    )
    return (
        lost.where("_cell.missing > 0")
        .groupBy("listener", "count_log2", "_cell.index_log2")
        .agg(F.sum("_cell.missing").alias("fragments"))
    )


def handler_stats(routed: DataFrame, sink: str) -> DataFrame:
    """Messages and bytes a sink saw and left out, per topic."""
    sent = F.col("topic") != DISCARDED_TOPIC
    size = F.octet_length("value").cast("bigint")
    return routed.groupBy("topic").agg(
        F.lit(sink).alias("name"),
        F.count(F.lit(1)).alias("seen_messages"),
        F.count_if(sent).alias("sent_messages"),
        F.coalesce(F.sum(F.when(sent, size)), F.lit(0)).alias("sent_bytes"),
    )


def size_profile(df: DataFrame, column: str, exact: bool = False) -> DataFrame:
    """Distribution of a size column. Approximate percentiles merge small sketches; exact
    ones keep a count per distinct value."""
    size = F.col(column)
    points = [0.5, 0.75, 0.95, 0.99]
    levels = F.percentile(size, points) if exact else F.percentile_approx(size, points, 100000)
    profile = df.agg(
        F.count(size).alias("n"),
        F.min(size).cast("bigint").alias("smallest"),
        F.max(size).cast("bigint").alias("largest"),
        F.sum(size.cast("bigint")).alias("total"),
        F.avg(size).alias("mean"),
        F.stddev_pop(size).alias("deviation"),
        levels.alias("_levels"),
    )
    named = [F.col("_levels")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(points)]
    return profile.select("*", *named).drop("_levels")


def _joined(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    other = right.select(F.col("listener").alias("_listener"), *columns)
    joined = left.join(other, left.listener.eqNullSafe(other._listener), "full_outer")
    return joined.withColumn("listener", F.coalesce("listener", "_listener")).drop("_listener")


def statistics(
    packets: DataFrame,
    fragments: DataFrame,
    checked: DataFrame,
    invalid: DataFrame,
    generations: DataFrame,
    cache: DataFrame,
    holes_new: DataFrame | None = None,
    holes_dead: DataFrame | None = None,
) -> DataFrame:
    """All statistics, one row per listener; every input is aggregated before the joins."""
    zero_row = F.array_repeat(F.lit(0).cast("bigint"), SLOTS)
    zero_triangle = F.transform(
        F.sequence(F.lit(1), F.lit(SLOTS)),
        lambda cells: F.array_repeat(F.lit(0).cast("bigint"), cells),
    )

    def hole_sum(holes: DataFrame | None, name: str) -> DataFrame:
        if holes is None:
            return result.select("listener", F.lit(0).cast("bigint").alias(name))
        return holes.groupBy("listener").agg(F.sum("holes").alias(name))

    result = counters(packets)
    scalar_names = [c for c in result.columns if c != "listener"]
    for name, part in [
        ("v0_fragments", fragment_index_histogram(fragments)),
        ("v0_invalid_checksum", checksum_histogram(checked)),
        ("v0_invalid_fragments", triangle(invalid_histogram(invalid))),
        ("dropped_fragments", triangle(dropped_histogram(generations))),
    ]:
        result = _joined(result, part.withColumnRenamed("histogram", name), name)
    received = checked.groupBy("listener").agg(F.count_if("checksum_ok").alias("v0_multipart_messages"))
    result = _joined(result, received, "v0_multipart_messages")
    for name, holes in [("holes_from_new_message", holes_new), ("holes_from_dead_port", holes_dead)]:
        result = _joined(result, hole_sum(holes, name), name)
        scalar_names.append(name)
    result = _joined(result, cache, "evictions", "hits", "misses")
    scalar_names.append("v0_multipart_messages")
    store = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("evictions", "hits", "misses")])
    return result.select(
        "listener",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in scalar_names],
        # Every packet has a kind here, so none is left without a handler.
        F.lit(0).cast("bigint").alias("unhandled_objects"),
        *[
            F.coalesce(c, zero_row).alias(c)
            for c in ("v0_fragments", "v0_invalid_checksum")
        ],
        *[
            F.coalesce(c, zero_triangle).alias(c)
            for c in ("v0_invalid_fragments", "dropped_fragments")
        ],
        store.alias("defragmenter"),
    )


def stats_json(statistics_rows: DataFrame, handlers: Column | None = None) -> DataFrame:
    """One JSON document per listener."""
    names = [c for c in statistics_rows.columns if c != "listener"]
    shown = handlers if handlers is not None else F.array().cast("array<struct<name:string>>")
    return statistics_rows.select(
        "listener", F.to_json(F.struct(*names, shown.alias("handlers"))).alias("stats")
    )
