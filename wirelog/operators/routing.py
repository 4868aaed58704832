"""Topic, key and partition of a message, from its tags; and payload encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.functions.hashing import key_group_partition, spread_null_keys
from wirelog.schemas import DEFAULT_MAX_PARALLELISM

# Fixed values of the tag convention.
TOPIC_PREFIX = "kt:"
KEY_PREFIX = "pk:"
DISCARDED_TOPIC = "null"


def last_tag(prefix: str, tags: str = "tags") -> Column:
    """Value of the last tag with ``prefix``, NULL when there is none."""
    matching = F.filter(tags, lambda tag: F.startswith(tag, F.lit(prefix)))
    return F.substring(F.try_element_at(matching, F.lit(-1)), len(prefix) + 1, 2**31 - 1)


def route(messages: DataFrame, default_topic: str) -> DataFrame:
    """The ``routed`` table: topic, key and bytes. Without a key tag the key is NULL."""
    return messages.select(
        "ts",
        F.coalesce(last_tag(TOPIC_PREFIX), F.lit(default_topic)).alias("topic"),
        last_tag(KEY_PREFIX).alias("key"),
        F.col("payload").alias("value"),
    )


def drop_null_topic(routed: DataFrame) -> DataFrame:
    """Leave out what is addressed to the discarding topic."""
    return routed.where(F.col("topic") != DISCARDED_TOPIC)


def assign_partition(
    routed: DataFrame,
    num_partitions: int,
    max_parallelism: int = DEFAULT_MAX_PARALLELISM,
    spread: list[str] | None = None,
) -> DataFrame:
    """Add ``partition``. Rows without key stay NULL, so the producer spreads them, unless
    ``spread`` names the columns for a reproducible choice."""
    partition = key_group_partition("key", num_partitions, max_parallelism)
    if spread:
        partition = spread_null_keys("key", partition, spread, num_partitions)
    return routed.withColumn("partition", partition)


def encrypt(messages: DataFrame, key: str, mode: str = "CBC", payload: str = "payload") -> DataFrame:
    """Replace the payload by IV followed by ciphertext (AES).

    A failure fails the job: nothing is ever sent in the clear instead. ECB has no IV and is
    not offered. The key comes from a table of one row, whose values no plan shows.
    """
    if mode not in ("CBC", "GCM"):
        raise ValueError(f"unsupported mode {mode!r}")
    if len(key.encode()) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    sealed = F.aes_encrypt(F.col(payload), _key(messages, key), F.lit(mode), _padding(mode))
    return messages.withColumn(payload, sealed)


def decrypt(messages: DataFrame, key: str, mode: str = "CBC", payload: str = "payload") -> DataFrame:
    opened = F.aes_decrypt(F.col(payload), _key(messages, key), F.lit(mode), _padding(mode))
    return messages.withColumn(payload, opened)


def _key(messages: DataFrame, key: str) -> Column:
    rows = messages.sparkSession.createDataFrame([(bytearray(key.encode()),)], "secret binary")
    return rows.scalar()


def _padding(mode: str) -> Column:
    return F.lit("PKCS" if mode == "CBC" else "NONE")
