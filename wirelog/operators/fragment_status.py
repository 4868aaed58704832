"""What becomes of each fragment: its generation, its first header and its status.

``with_status`` is the usual way: one exchange, on the message key, and two sorts.
``with_status_spread`` gives the same columns for keys with very many rows: such a key is
never brought together, its rows stay spread over time buckets, and what must be known
about all of them comes from small tables aggregated before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelog.operators.decode import message_key
from wirelog.operators.joins import join_on
from wirelog.schemas import ARRIVAL, DEFAULT_EXPIRE
from wirelog.session import duration_us

HEADER = ["fragment_count", "fragment_size", "msg_hash", "total_length"]


def arrival() -> Column:
    return F.struct(*ARRIVAL)


def tags_arrival() -> Column:
    """When the tags came; NULL for a fragment without any."""
    return F.when(F.col("tags").isNotNull(), arrival()).alias("tags_at")


def with_payload_length(fragments: DataFrame) -> DataFrame:
    if "payload_length" in fragments.columns:
        return fragments
    return fragments.withColumn("payload_length", F.octet_length("payload"))


def with_generation(
    fragments: DataFrame, expire: str = DEFAULT_EXPIRE, key: list[str] | None = None
) -> DataFrame:
    """Number the attempts at one message: ``expire`` without a touch starts a new one.

    ``first_header`` is that of the generation's first arrival, valid or not; it fixes
    count, size, hash and length for all. Both share one window and one sort. Of headers that
    arrive at once the least comes first.
    """
    by_arrival = Window.partitionBy(*(key or message_key())).orderBy(*ARRIVAL, *HEADER)
    micros = F.unix_micros("ts")
    idle = micros - F.lag(micros).over(by_arrival)
    starts = F.col("_starts")
    header = F.when(starts, F.struct(*HEADER))
    marked = fragments.select("*", F.coalesce(idle >= duration_us(expire), F.lit(True)).alias("_starts"))
    return marked.select(
        *fragments.columns,
        (F.sum(starts.cast("int")).over(by_arrival) - 1).cast("int").alias("generation"),
        F.last(header, ignorenulls=True).over(by_arrival).alias("first_header"),
    )


def fragment_is_valid() -> Column:
    """Agrees with the first header, and has the length its place in the message demands."""
    first = F.col("first_header")
    offset = F.col("fragment_size").cast("bigint") * F.col("fragment_index")
    is_last = F.col("fragment_index") == F.col("fragment_count") - 1
    expected = F.when(is_last, first["total_length"] - offset).otherwise(first["fragment_size"])
    return (
        (F.col("fragment_size") == first["fragment_size"])
        & (F.col("fragment_count") == first["fragment_count"])
        & (F.col("msg_hash") == first["msg_hash"])
        & (F.col("payload_length") == expected)
    )


def _status(done: Column, replaced: Column) -> Column:
    return (
        F.when(F.coalesce(arrival() > done, F.lit(False)), "late_duplicate")
        .when(~F.col("valid"), "invalid")
        .when(replaced, "superseded")
        .otherwise("kept")
    )


def _for_itself() -> list[Column]:
    """What a row that stands for no other has: a weight of one and its own arrival."""
    return [F.lit(1).cast("bigint").alias("weight"), tags_arrival(), arrival().alias("opened")]


def with_status(
    fragments: DataFrame, expire: str = DEFAULT_EXPIRE, key: list[str] | None = None
) -> DataFrame:
    """Add ``generation``, ``first_header`` and ``status`` to every fragment.

    ``kept``: part of the message. ``superseded``: valid, but a later valid arrival of the
    same index came before the message was complete. ``late_duplicate``: came after it was
    complete. ``invalid``: disagrees with the first header.
    """
    key = key or message_key()
    group = [*key, "generation"]
    staged = with_generation(with_payload_length(fragments), expire, key)
    staged = staged.withColumn("valid", fragment_is_valid())
    columns = staged.columns
    same_index = Window.partitionBy(*group, "valid", "fragment_index").orderBy(*ARRIVAL)
    # Ordered by index within the generation already, so this one sorts nothing.
    generation = Window.partitionBy(*group)
    opens_index = F.col("valid") & (F.col("_nth") == 1)
    staged = staged.select(
        "*",
        F.row_number().over(same_index).alias("_nth"),
        F.lead(arrival()).over(same_index).alias("_next"),
    ).select(
        *columns,
        "_next",
        F.count_if(opens_index).over(generation).alias("_distinct"),
        F.max(F.when(opens_index, arrival())).over(generation).alias("_last_new"),
    )
    complete = F.col("_distinct") == F.col("first_header.fragment_count")
    done = F.when(complete, F.col("_last_new"))
    replaced = F.col("_next").isNotNull() & (done.isNull() | (F.col("_next") <= done))
    kept = [c for c in columns if c != "valid"]
    return staged.select(*kept, _status(done, replaced).alias("status"), *_for_itself())


def time_bucket(width_us: int) -> Column:
    """Bucket of ``ts``: two arrivals in one bucket are always closer than its width."""
    micros = F.unix_micros("ts")
    return micros - F.pmod(micros, F.lit(width_us))


def with_status_spread(
    fragments: DataFrame, expire: str = DEFAULT_EXPIRE, key: list[str] | None = None
) -> DataFrame:
    """:func:`with_status` for crowded keys, with ``superseded`` rows folded into the
    ``kept`` row of their index: its ``weight`` counts them and ``opened`` is the earliest.
    Rows of any other status stay as they are.

    Rows meet what is known about their key in joins, whose skewed partitions adaptive
    execution splits; everything else is an aggregate that combines before its shuffle.
    """
    key = key or message_key()
    width = duration_us(expire)
    rows = with_payload_length(fragments).withColumn("_bucket", time_bucket(width))
    buckets = rows.groupBy(*key, "_bucket").agg(
        F.min("ts").alias("_from"),
        F.max("ts").alias("_to"),
        F.min(F.struct(*ARRIVAL, *HEADER)).alias("_header"),
    )
    in_time = Window.partitionBy(*key).orderBy("_bucket")
    idle = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(in_time))
    starts = F.col("_starts")
    header = F.struct(*[F.col(f"_header.{c}").alias(c) for c in HEADER])
    placed = buckets.select("*", F.coalesce(idle >= width, F.lit(True)).alias("_starts")).select(
        *key,
        "_bucket",
        (F.sum(starts.cast("int")).over(in_time) - 1).cast("int").alias("generation"),
        F.last(F.when(starts, header), ignorenulls=True).over(in_time).alias("first_header"),
    )
    staged = join_on(rows, placed, [*key, "_bucket"]).withColumn("valid", fragment_is_valid())
    group = [*key, "generation"]
    count = F.first("first_header.fragment_count")
    first_of_index = (
        staged.where("valid")
        .groupBy(*group, "fragment_index")
        .agg(F.min(arrival()).alias("_first"), count.alias("_count"))
    )
    done = (
        first_of_index.groupBy(*group)
        .agg(
            F.max("_first").alias("_done"),
            F.count(F.lit(1)).alias("_distinct"),
            F.first("_count").alias("_count"),
        )
        .where(F.col("_distinct") == F.col("_count"))
        .select(*group, "_done")
    )
    status = _status(F.col("_done"), F.lit(False))
    judged = (
        join_on(staged, done, group, "left")
        .withColumn("status", status)
        .drop("_bucket", "_done", "valid")
    )
    plain = judged.columns
    judged = judged.select("*", *_for_itself())
    folded = ["tags", "tags_at", "weight", "opened"]
    rest = [c for c in plain if c not in (*group, "fragment_index", "status", *folded)]
    kept = (
        judged.where("status = 'kept'")
        .groupBy(*group, "fragment_index", "status")
        .agg(
            F.max_by("tags", "tags_at").alias("tags"),
            F.max("tags_at").alias("tags_at"),
            F.sum("weight").alias("weight"),
            F.min("opened").alias("opened"),
            F.max_by(F.struct(*rest), arrival()).alias("_last"),
        )
        .select(*group, "fragment_index", "status", *folded, "_last.*")
    )
    return kept.select(judged.columns).unionByName(judged.where("status <> 'kept'"))
