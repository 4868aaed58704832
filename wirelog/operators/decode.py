"""Datagram classification, fragment headers and commands. All narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.functions.binary import (
    i32,
    slice_bytes,
    split_tags,
    u16,
    utf8_text,
)
from wirelog.schemas import ARRIVAL, HEADER_FIELDS, HEADER_SIZE, KNOWN_COMMANDS, SENDER


# Version 0, then the packet type.
COMMAND = bytearray(b"\x00\x00")
FRAGMENT = bytearray(b"\x00\x01")


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def packet_kind(data: Column | str = "data") -> Column:
    """simple, command, fragment, invalid_version, invalid_type or decode_error."""
    first, both = slice_bytes(data, 0, 1), slice_bytes(data, 0, 2)
    size = F.octet_length(data)
    return (
        F.when(size == 0, "decode_error")
        .when(first > F.lit(bytearray(b"\x1f")), "simple")
        .when(first > F.lit(bytearray(b"\x00")), "invalid_version")
        .when(size == 1, "decode_error")
        .when(both == F.lit(COMMAND), "command")
        .when(both == F.lit(FRAGMENT), "fragment")
        .otherwise("invalid_type")
    )


def classify_packets(packets: DataFrame) -> DataFrame:
    return packets.withColumn("kind", packet_kind())


def _starting(packets: DataFrame, prefix: bytearray) -> DataFrame:
    """Datagrams of one boxed kind, by a comparison of their first two bytes."""
    return packets.where(slice_bytes("data", 0, 2) == F.lit(prefix))


def simple_messages(packets: DataFrame) -> DataFrame:
    """Unboxed datagrams: the whole packet is the payload."""
    return packets.where(slice_bytes("data", 0, 1) > F.lit(bytearray(b"\x1f"))).select(
        "listener",
        F.lit("udp").alias("transport"),
        "ts",
        "sender_host",
        "sender_port",
        F.lit(None).cast("int").alias("msg_id"),
        F.lit(None).cast("int").alias("fragment_count"),
        _no_tags().alias("tags"),
        F.col("data").alias("payload"),
    )


def parse_commands(packets: DataFrame) -> DataFrame:
    """Audit rows of command datagrams. ``known`` is false for words outside the fixed set
    and for datagrams too short to hold a word (their ``command`` is NULL)."""
    long_enough = F.octet_length("data") >= 6
    word = F.upper(utf8_text(slice_bytes("data", 2, 4)))
    return (
        _starting(packets, COMMAND)
        .withColumn("command", F.when(long_enough, word))
        .withColumn(
            "trail",
            F.when(long_enough, slice_bytes("data", 6, F.octet_length("data") - 6)),
        )
        .withColumn("known", F.coalesce(F.col("command").isin(KNOWN_COMMANDS), F.lit(False)))
        .select(*SENDER, *ARRIVAL, "command", "trail", "known")
    )


def parse_fragments(packets: DataFrame) -> DataFrame:
    """Header fields of fragment datagrams plus ``reason``, NULL where the header is valid."""
    size = F.octet_length("data")
    parsed = _starting(packets, FRAGMENT).select(
        *SENDER,
        *ARRIVAL,
        "data",
        u16("data", 2).alias("fragment_count"),
        u16("data", 4).alias("fragment_index"),
        u16("data", 6).alias("fragment_size"),
        i32("data", 8).alias("msg_id"),
        i32("data", 12).alias("total_length"),
        i32("data", 16).alias("msg_hash"),
        u16("data", 20).alias("tags_length"),
    )
    reason = (
        F.when(size < HEADER_SIZE, "short_header")
        .when(F.col("fragment_count") == 0, "zero_count")
        .when(F.col("fragment_index") >= F.col("fragment_count"), "index_out_of_range")
        .when(F.col("total_length") < 0, "negative_length")
        .when(F.col("tags_length") > size - HEADER_SIZE, "tags_overrun")
    )
    return parsed.withColumn("reason", reason)


def valid_fragments(packets: DataFrame) -> DataFrame:
    """The ``fragments`` table. ``tags`` is NULL for a fragment without tag bytes."""
    start = F.col("tags_length") + HEADER_SIZE
    has_tags = F.col("tags_length") > 0
    payload = slice_bytes("data", start, F.octet_length("data") - start)
    return (
        parse_fragments(packets)
        .where(F.col("reason").isNull())
        .select(
            *SENDER,
            *ARRIVAL,
            *HEADER_FIELDS,
            F.when(
                has_tags, split_tags(slice_bytes("data", HEADER_SIZE, F.col("tags_length")))
            ).alias("tags"),
            payload.alias("payload"),
            (F.octet_length("data") - start).alias("payload_length"),
        )
    )


def header_rejects(packets: DataFrame) -> DataFrame:
    """The ``rejects`` rows of malformed fragment headers."""
    return (
        parse_fragments(packets)
        .where(F.col("reason").isNotNull())
        .select("listener", "ts", "seq", "reason", "data")
    )


def packet_rejects(packets: DataFrame) -> DataFrame:
    """Datagrams refused before any header: wrong version or type, or too few bytes."""
    refused = ["invalid_version", "invalid_type", "decode_error"]
    return (
        classify_packets(packets)
        .where(F.col("kind").isin(refused))
        .select("listener", "ts", "seq", F.col("kind").alias("reason"), "data")
    )


def split_rejects(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    return valid_fragments(packets), header_rejects(packets)


def split_single_multi(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single-fragment messages need no reassembly, so they never reach a shuffle. On a
    stored table with an ``alone`` partition column each side reads its own files."""
    stored = "alone" in fragments.columns
    alone = F.col("alone") if stored else F.col("fragment_count") == 1
    return fragments.where(alone), fragments.where(~alone)


def message_key(mode: str = "sender") -> list[str]:
    """Grouping columns of one message; ``port_only`` ignores the sender's host.

    Numbers come first: sorts compare a fixed-width prefix of the first column, and the id
    tells most messages apart where a listener's name tells none.
    """
    if mode == "sender":
        return ["msg_id", "sender_port", "sender_host", "listener"]
    if mode == "port_only":
        return ["msg_id", "sender_port", "listener"]
    raise ValueError(f"unknown key mode {mode!r}")


def numeric_message_key() -> Column:
    """Port and id packed in one bigint; a negative id borrows from the port part."""
    return F.shiftleft(F.col("sender_port").cast("bigint"), 32) + F.col("msg_id")
