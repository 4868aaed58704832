"""From captured datagrams to messages, rejects and loss tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelog.operators.decode import (
    header_rejects,
    message_key,
    packet_rejects,
    parse_commands,
    simple_messages,
    split_single_multi,
    valid_fragments,
)
from wirelog.operators.defrag import (
    HOT_KEY_ROWS,
    defrag_cache_stats,
    defragment,
    find_hot_keys,
    missing_fragments,
    single_messages,
    with_checksum,
)
from wirelog.operators.holes import new_message_ids
from wirelog.operators.id_scan import scan_ids
from wirelog.operators.messages import all_messages, as_messages
from wirelog.operators.stats import statistics
from wirelog.schemas import (
    DEFAULT_EXPIRE,
    DEFAULT_IDLE,
    DEFAULT_IDS_PER_PORT,
    DEFAULT_MAX_HOLE,
)


def store_fragments(packets: DataFrame, path: str) -> DataFrame:
    """The ``fragments`` table as Parquet, and back as a DataFrame.

    Header fields become columns of their own, so that passes which need no payload read
    none. Single-fragment messages lie in a directory of their own: reassembly and the path
    around it each read their part only.
    """
    alone = F.col("fragment_count") == 1
    rows = valid_fragments(packets).withColumn("alone", alone)
    rows.write.partitionBy("alone").parquet(path)
    return packets.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass(frozen=True)
class Capture:
    """Lazy tables of one decoded capture. ``statistics`` runs the hole detector, which pins
    its input, when it is first asked for."""

    messages: DataFrame
    commands: DataFrame
    rejects: DataFrame
    missing: DataFrame
    ids: DataFrame
    count: Callable[[], DataFrame]

    @cached_property
    def statistics(self) -> DataFrame:
        return self.count()


def decode_capture(
    packets: DataFrame,
    expire: str = DEFAULT_EXPIRE,
    key_mode: str = "sender",
    hot_key_rows: int | None = HOT_KEY_ROWS,
    fragments_path: str | None = None,
    detect_holes: bool = True,
    idle: str = DEFAULT_IDLE,
    ids_per_port: int = DEFAULT_IDS_PER_PORT,
    max_hole: int = DEFAULT_MAX_HOLE,
) -> Capture:
    """Decode everything in ``packets``.

    The hole counters of ``statistics`` come from the online detector with ``idle``,
    ``ids_per_port`` and ``max_hole``; without ``detect_holes`` they are 0.

    With ``fragments_path`` the parsed fragments are stored there first, see
    :func:`store_fragments`: the raw capture is then parsed once, however many of the tables
    are used. A pass over four narrow columns finds message keys with more than
    ``hot_key_rows`` fragments (None: skip it); only those take the spread path.
    """
    key = message_key(key_mode)
    if fragments_path:
        fragments = store_fragments(packets, fragments_path)
    else:
        fragments = valid_fragments(packets)
    single, several = split_single_multi(fragments)
    hot = find_hot_keys(several, hot_key_rows, key) if hot_key_rows else None
    multi = defragment(several, expire, key, hot, singles=False)
    checked = with_checksum(multi.messages.unionByName(single_messages(single)))
    whole = checked.where("checksum_ok")
    rejects = [
        packet_rejects(packets),
        header_rejects(packets),
        multi.invalid.select(
            "listener", "ts", "seq", F.lit("invalid_fragment").alias("reason"),
            F.col("payload").alias("data"),
        ),
        multi.late_duplicates.select(
            "listener", "ts", "seq", F.lit("late_duplicate").alias("reason"),
            F.col("payload").alias("data"),
        ),
        checked.where(~F.col("checksum_ok")).select(
            "listener", "ts", F.lit(None).cast("bigint").alias("seq"),
            F.lit("checksum").alias("reason"), F.col("payload").alias("data"),
        ),
    ]
    joined = rejects[0]
    for part in rejects[1:]:
        joined = joined.unionByName(part)
    ids = new_message_ids(fragments, multi.generations)

    def count() -> DataFrame:
        holes: list[DataFrame | None] = [None, None]
        if detect_holes:
            found = scan_ids(ids, idle, ids_per_port, max_hole, every_arrival=False)
            holes = [found.where(F.col("kind") == kind) for kind in ("arrival", "lease_end")]
        return statistics(
            packets,
            fragments,
            checked,
            multi.invalid,
            multi.generations,
            defrag_cache_stats(multi.generations),
            *holes,
        )

    return Capture(
        messages=all_messages(simple_messages(packets), as_messages(whole)),
        commands=parse_commands(packets),
        rejects=joined,
        missing=missing_fragments(multi.incomplete),
        ids=ids,
        count=count,
    )


def decode_listeners(
    packets: DataFrame, settings: dict[str, dict], defaults: dict | None = None
) -> Capture:
    """Decode each listener of ``settings`` with its own arguments of :func:`decode_capture`,
    which fall back to ``defaults``; rows of other listeners are decoded with the defaults.

    With a ``fragments_path`` in ``defaults`` the capture is read once and stored there by listener, so each
    decoding reads its own part; their fragments lie beside it, a folder for each.
    """
    defaults = dict(defaults or {})
    path = defaults.pop("fragments_path", None)
    if path:
        packets.write.partitionBy("listener").parquet(f"{path}/by-listener")
        packets = packets.sparkSession.read.schema(packets.schema).parquet(f"{path}/by-listener")

    def place(name: str) -> dict:
        return {"fragments_path": f"{path}/fragments-{name}"} if path else {}

    own = [
        decode_capture(packets.where(F.col("listener") == name), **{**defaults, **place(str(n)), **arguments})
        for n, (name, arguments) in enumerate(settings.items())
    ]
    named = F.col("listener").isin(list(settings)) if settings else F.lit(False)
    others = packets.where(~F.coalesce(named, F.lit(False)))
    parts = [*own, decode_capture(others, **defaults, **place("others"))]

    def every(table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(part, table) for part in parts])

    return Capture(
        **{t: every(t) for t in ("messages", "commands", "rejects", "missing", "ids")},
        count=lambda: every("statistics"),
    )
