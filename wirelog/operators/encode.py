"""Splitting messages into fragment datagrams, and numbering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.functions.binary import hex_digits, join_tags, latin1_bytes, slice_bytes
from wirelog.functions.hashing import murmur3_32
from wirelog.operators.ordering import with_rank
from wirelog.schemas import (
    ARRIVAL,
    DEFAULT_CHUNK_SIZE,
    HEADER_SIZE,
    MAX_UDP_PAYLOAD,
    SENDER,
)

MAX_ID = 2**31 - 2
MAX_FIELD = 65535  # sizes and counts of the header have 16 bits


def tags_fit(tags: Column | str, max_fragment_size: int) -> Column:
    """Whether the encoded tags fit in one fragment, counted in bytes."""
    return F.octet_length(join_tags(tags)) <= max_fragment_size - HEADER_SIZE


def _planned(messages: DataFrame, room: int) -> DataFrame:
    """Add hash, tag bytes, fragment count and ``reason`` (NULL where it can be sent)."""
    payload_length = F.octet_length("payload").cast("bigint")
    tag_length = F.octet_length("_tag_bytes").cast("bigint")
    wanted = payload_length + tag_length
    reason = (
        F.when(F.col("fragment_count") == 0, "empty")
        .when(tag_length > F.lit(min(room, MAX_FIELD)), "tags_too_large")
        .when(F.col("fragment_count") > MAX_FIELD, "too_many_fragments")
        .when(payload_length < (F.col("fragment_count") - 1) * room, "tags_spill")
    )
    tagged = messages if "tags" in messages.columns else messages.withColumn("tags", F.lit(None))
    return (
        tagged.withColumn("_tag_bytes", join_tags(F.col("tags").cast("array<string>")))
        .withColumn("fragment_count", F.call_function("div", wanted + (room - 1), F.lit(room)))
        .withColumn("reason", reason)
    )


def packetize(
    messages: DataFrame, max_fragment_size: int, size_field: int | None = None
) -> DataFrame:
    """Fragment datagrams of ``messages`` (sender columns, ``msg_id``, ``payload``, ``tags``).

    The pieces are cut inside one array before the explode, so a row of the output carries
    its own piece and never the whole payload. Tags travel on the last fragment only.
    """
    room = max_fragment_size - HEADER_SIZE
    if room < 1:
        raise ValueError(f"fragment size must exceed {HEADER_SIZE}")
    if max(room, size_field or 0) > MAX_FIELD:
        raise ValueError(f"a piece of more than {MAX_FIELD} bytes has no place in the header")
    planned = _planned(messages, room).where(F.col("reason").isNull())
    last = F.col("fragment_count") - 1
    length = F.octet_length("payload")

    def piece(index: Column, digest: Column) -> Column:
        start = index * room
        is_last = index == last
        header = F.unhex(
            F.concat(
                F.lit("0001"),
                hex_digits(F.col("fragment_count"), 2),
                hex_digits(index, 2),
                hex_digits(F.lit(size_field or room), 2),
                hex_digits(F.col("msg_id"), 4),
                hex_digits(length, 4),
                hex_digits(digest, 4),
                hex_digits(F.when(is_last, F.octet_length("_tag_bytes")).otherwise(0), 2),
                F.lit("0000"),
            )
        )
        tag_part = F.when(is_last, F.col("_tag_bytes")).otherwise(F.lit(bytearray()))
        body = slice_bytes("payload", start, F.least(F.lit(room), length - start))
        return F.struct(
            index.cast("int").alias("fragment_index"), F.concat(header, tag_part, body).alias("data")
        )

    indices = F.sequence(F.lit(0).cast("bigint"), last)
    # The digest is bound outside the inner lambda: one hash per message, not per piece.
    pieces = F.transform(
        F.array(murmur3_32("payload")),
        lambda digest: F.transform(indices, lambda index: piece(index, digest)),
    )[0]
    return planned.withColumn("_piece", F.explode(pieces)).select(
        *SENDER, *ARRIVAL, "msg_id", "_piece.fragment_index", "_piece.data"
    )


def packetize_rejects(messages: DataFrame, max_fragment_size: int) -> DataFrame:
    """Messages that cannot be split: nothing to send, or tags that do not fit."""
    planned = _planned(messages, max_fragment_size - HEADER_SIZE)
    return planned.where(F.col("reason").isNotNull()).select(
        "listener", "ts", "seq", "reason", F.col("payload").alias("data")
    )


def chunk(messages: DataFrame, chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """Client-side chunking of untagged payloads; an empty payload sends nothing."""
    if not 0 < chunk_size < MAX_UDP_PAYLOAD - HEADER_SIZE:
        raise ValueError("chunk size out of range")
    untagged = messages.withColumn("tags", F.lit(None).cast("array<string>"))
    return packetize(untagged, chunk_size + HEADER_SIZE)


def text_payload(messages: DataFrame, text: str) -> DataFrame:
    """Payload bytes of a client's text, one byte per character."""
    return messages.withColumn("payload", latin1_bytes(text))


def assign_message_ids(messages: DataFrame) -> DataFrame:
    """Increasing ids per sender in arrival order, from 1 and wrapping at the largest int."""
    ranked = with_rank(messages, SENDER, ARRIVAL, "_rank")
    wrapped = F.pmod(F.col("_rank") - 1, F.lit(MAX_ID)) + 1
    return ranked.withColumn("msg_id", wrapped.cast("int")).drop("_rank")
