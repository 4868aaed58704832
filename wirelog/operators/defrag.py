"""Reassembly of multi-fragment messages.

The usual path needs one exchange, on the message key; every window and the final aggregate
reuse that partitioning. Keys with very many rows (a sender that repeats one id, say) would
make one task large, so ``find_hot_keys`` names them and ``defragment`` sends them another
way with the same result, see ``fragment_status``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.functions.binary import log2_bucket
from wirelog.functions.hashing import with_murmur3
from wirelog.operators.decode import message_key, split_single_multi
from wirelog.operators.fragment_status import (
    arrival,
    with_payload_length,
    with_status,
    with_status_spread,
)
from wirelog.operators.joins import join_on
from wirelog.schemas import DEFAULT_EXPIRE
from wirelog.session import cut_lineage

def assemble(staged: DataFrame, key: list[str] | None = None, payload: bool = True) -> DataFrame:
    """One row per generation from fragments with status; no exchange after the windows."""
    key = key or message_key()
    kept = F.col("status") == "kept"
    bytes_in_order = F.expr(
        "listagg(payload) within group (order by fragment_index) filter (where status = 'kept')"
    )
    aggregates = [
        F.first("first_header").alias("first_header"),
        F.max(F.when(kept, arrival()))["ts"].alias("ts"),
        F.min("opened")["ts"].alias("first_ts"),
        F.min("opened")["seq"].alias("first_seq"),
        F.count_if(kept).alias("received"),
        F.sum(F.when(F.col("status") != "late_duplicate", F.col("weight"))).alias("touches"),
        F.count_if(F.col("status") == "late_duplicate").alias("late_duplicates"),
        F.max_by("tags", F.when(F.col("status").isin("kept", "superseded"), F.col("tags_at"))).alias(
            "tags"
        ),
        F.collect_list(F.when(kept, F.col("fragment_index"))).alias("indices"),
    ]
    if payload:
        aggregates.append(bytes_in_order.alias("payload"))
    carried = [c for c in ["sender_host"] if c not in key and c in staged.columns]
    aggregates += [F.min_by(c, "opened").alias(c) for c in carried]
    return staged.groupBy(*key, "generation").agg(*aggregates)


def is_complete() -> Column:
    """Every index has arrived. Indices are distinct after deduplication."""
    return F.col("received") == F.col("first_header.fragment_count")


def _complete_messages(assembled: DataFrame, key: list[str]) -> DataFrame:
    columns = list(dict.fromkeys(["listener", "sender_host", "sender_port", "msg_id", *key]))
    return assembled.where(is_complete()).select(
        *columns,
        "generation",
        "ts",
        F.col("first_header.fragment_count").alias("fragment_count"),
        F.col("first_header.total_length").alias("total_length"),
        F.col("first_header.msg_hash").alias("msg_hash"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("payload", F.lit(bytearray())).alias("payload"),
    )


def missing_indices(count: Column, received: Column) -> Column:
    """All indices of a message except the received ones."""
    return F.array_except(F.sequence(F.lit(0), count - 1), received)


def _incomplete_messages(assembled: DataFrame, key: list[str]) -> DataFrame:
    count = F.col("first_header.fragment_count")
    columns = list(dict.fromkeys(["listener", "sender_host", "sender_port", "msg_id", *key]))
    return assembled.where(~is_complete()).select(
        *columns,
        "generation",
        "first_ts",
        "first_seq",
        count.alias("fragment_count"),
        "touches",
        missing_indices(count, F.col("indices")).alias("missing"),
    )


BROADCAST_KEYS = 10000


@dataclass(frozen=True)
class Reassembly:
    """Outputs of one reassembly; each is lazy and reads only the columns it needs."""

    messages: DataFrame
    incomplete: DataFrame
    invalid: DataFrame
    late_duplicates: DataFrame
    generations: DataFrame


# Several times the largest fragment count of one message, and what a task can hold and sort.
HOT_KEY_ROWS = 1_000_000
HOT_KEY_BYTES = 1 << 30


def find_hot_keys(
    fragments: DataFrame,
    min_rows: int = HOT_KEY_ROWS,
    key: list[str] | None = None,
    min_bytes: int = HOT_KEY_BYTES,
) -> DataFrame:
    """Keys with more than ``min_rows`` fragments or ``min_bytes`` of payload; reads narrow
    columns of a stored ``fragments`` table and combines before the shuffle."""
    key = key or message_key()
    counted = with_payload_length(fragments).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.col("payload_length").cast("bigint")).alias("_bytes")
    )
    return counted.where((F.col("_rows") > min_rows) | (F.col("_bytes") > min_bytes)).select(*key)


def _staged_parts(
    fragments: DataFrame, expire: str, key: list[str], hot_keys: DataFrame | None
) -> list[DataFrame]:
    hot = None if hot_keys is None else _sized(hot_keys.select(*key))
    if hot is None:
        return [with_status(fragments, expire, key)]
    return [
        with_status(join_on(fragments, hot, key, "left_anti"), expire, key),
        with_status_spread(join_on(fragments, hot, key, "left_semi"), expire, key),
    ]


def _sized(hot_keys: DataFrame) -> DataFrame | None:
    """The keys, computed once: broadcast when they are few, an ordinary join when many,
    None when there are none."""
    few = hot_keys.limit(BROADCAST_KEYS + 1).collect()
    if not few:
        return None
    if len(few) > BROADCAST_KEYS:
        return cut_lineage(hot_keys)
    return F.broadcast(hot_keys.sparkSession.createDataFrame(few, hot_keys.schema))


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def defragment(
    fragments: DataFrame,
    expire: str = DEFAULT_EXPIRE,
    key: list[str] | None = None,
    hot_keys: DataFrame | None = None,
    singles: bool = True,
) -> Reassembly:
    """Reassemble ``fragments``; see :class:`Reassembly` for the outputs.

    ``hot_keys`` comes from :func:`find_hot_keys`. Single-fragment messages need no assembly:
    with ``singles`` they stand in ``messages`` as :func:`single_messages` gives them, are
    neither incomplete nor invalid whatever they declare, and still count in ``generations``;
    input without any saves that with ``singles=False``. Each part is assembled before the union,
    so the usual part keeps its partitioning. Checksums are not judged here, see
    :func:`verify_checksum`.
    """
    key = key or message_key()
    parts = _staged_parts(fragments, expire, key, hot_keys)
    assembled = _union(assemble(part, key) for part in parts)
    counted = _union(assemble(part, key, payload=False) for part in parts)
    staged = _union(parts)
    several = F.col("first_header.fragment_count") > 1 if singles else F.lit(True)
    messages = _complete_messages(assembled.where(several), key)
    invalid = staged.where(F.col("status") == "invalid")
    if singles:
        messages = messages.unionByName(single_messages(fragments).select(messages.columns))
        invalid = invalid.where(F.col("fragment_count") > 1)
    return Reassembly(
        messages=messages,
        incomplete=_incomplete_messages(counted.where(several), key),
        invalid=invalid,
        late_duplicates=staged.where(F.col("status") == "late_duplicate"),
        generations=counted,
    )


def single_messages(fragments: DataFrame) -> DataFrame:
    """Messages of one fragment; declared size and length are not checked."""
    return fragments.where(F.col("fragment_count") == 1).select(
        "listener",
        "sender_host",
        "sender_port",
        "msg_id",
        F.lit(0).alias("generation"),
        "ts",
        "fragment_count",
        "total_length",
        "msg_hash",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "payload",
    )


def with_checksum(messages: DataFrame) -> DataFrame:
    """Add ``checksum_ok``: whether the payload has the hash its header declares."""
    return (
        with_murmur3(messages, "payload", "_computed")
        .withColumn("checksum_ok", F.col("_computed") == F.col("msg_hash"))
        .drop("_computed")
    )


def verify_checksum(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages whose payload matches its hash, the others)."""
    checked = with_checksum(messages)
    ok = F.col("checksum_ok")
    return checked.where(ok).drop("checksum_ok"), checked.where(~ok).drop("checksum_ok")


def reassemble(fragments: DataFrame, **options) -> DataFrame:
    """Single and multi-fragment messages with their checksum verdict, before filtering.

    Crowded keys are looked for unless ``hot_keys`` names them or is None.
    """
    single, several = split_single_multi(fragments)
    if "hot_keys" not in options:
        options["hot_keys"] = find_hot_keys(several, key=options.get("key"))
    multi = defragment(several, singles=False, **options).messages
    return with_checksum(multi.unionByName(single_messages(single)))


def missing_fragments(incomplete: DataFrame) -> DataFrame:
    """One row per index that never arrived before its message was dropped."""
    return incomplete.withColumn("fragment_index", F.explode("missing")).drop("missing")


def defrag_cache_stats(generations: DataFrame) -> DataFrame:
    """Partial-message store counters per listener: misses, hits and evictions."""
    return generations.groupBy("listener").agg(
        F.count_if(~is_complete()).alias("evictions"),
        (F.coalesce(F.sum("touches"), F.lit(0)) - F.count(F.lit(1))).alias("hits"),
        F.count(F.lit(1)).alias("misses"),
    )


def loss_cell(count: Column | str, index: Column | str) -> list[Column]:
    """Row and column of the two-dimensional log2 histograms."""
    count = F.col(count) if isinstance(count, str) else count
    return [
        log2_bucket(count - 1).alias("count_log2"),
        log2_bucket(index).alias("index_log2"),
    ]
