"""Captured datagrams and lines as DataFrames, batch or streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelog.functions.binary import slice_bytes
from wirelog.schemas import DEFAULT_MAX_LINE, DEFAULT_RECEIVE_SIZE, MESSAGE_COLUMNS, PACKETS
from wirelog.sources.framed_lines import FramedLines


def read_packets(
    spark: SparkSession,
    path: str,
    listener: str | None = None,
    streaming: bool = False,
    receive_size: int = DEFAULT_RECEIVE_SIZE,
    **options: str,
) -> DataFrame:
    """Captured datagrams from Parquet. ``listener`` overrides the stored name; bytes past
    ``receive_size`` are cut off, as a socket buffer would."""
    reader = spark.readStream if streaming else spark.read
    packets = reader.options(**options).schema(PACKETS).parquet(path)
    return _received(packets, listener, receive_size)


def packets_from_kafka(
    spark: SparkSession,
    options: dict[str, str],
    listener: str,
    streaming: bool = True,
    receive_size: int = DEFAULT_RECEIVE_SIZE,
) -> DataFrame:
    """Datagrams kept as Kafka values; the sender is the record's
    key, ``host:port``. Needs the Kafka connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    records = reader.format("kafka").options(**options).load()
    sender = F.split(F.col("key").cast("string"), ":")
    packets = records.select(
        F.lit(listener).alias("listener"),
        F.col("timestamp").alias("ts"),
        # offsets repeat over partitions; this order does not
        (F.col("partition").cast("bigint") * (1 << 48) + F.col("offset")).alias("seq"),
        sender[0].alias("sender_host"),
        F.try_element_at(sender, F.lit(2)).cast("int").alias("sender_port"),
        F.col("value").alias("data"),
    )
    return _received(packets, None, receive_size)


def _received(packets: DataFrame, listener: str | None, receive_size: int) -> DataFrame:
    if listener is not None:
        packets = packets.withColumn("listener", F.lit(listener))
    whole = F.octet_length("data") <= receive_size
    cut = slice_bytes("data", 0, receive_size)
    return packets.withColumn("data", F.when(whole, F.col("data")).otherwise(cut))


def read_lines(
    spark: SparkSession,
    path: str,
    listener: str = "tcp",
    max_line: int = DEFAULT_MAX_LINE,
    reserved: str = "keep",
    streaming: bool = False,
    bounded: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(untagged messages, rejects) of newline-framed text files.

    With ``bounded`` no line is held whole: files are read by byte ranges, and of a line over ``max_line``
    only its beginning is kept, as the reject's data (see ``framed_lines`` for the stores it reaches).
    """
    if bounded:
        if streaming:
            raise ValueError("bounded lines are read from files at rest")
        spark.dataSource.register(FramedLines)
        lines = spark.read.format("framed_lines").option("max_line", max_line).load(path)
        return lines_to_messages(lines, listener, max_line, reserved)
    reader = spark.readStream if streaming else spark.read
    return lines_to_messages(reader.text(path, lineSep="\n"), listener, max_line, reserved)


def lines_to_messages(
    lines: DataFrame, listener: str, max_line: int = DEFAULT_MAX_LINE, reserved: str = "keep"
) -> tuple[DataFrame, DataFrame]:
    """Frame rules on a ``value`` column: one trailing carriage return goes, lines over
    ``max_line`` bytes are rejected, and so are lines that start with NUL if ``reserved`` is
    ``'reject'``. A line is bytes: what is not UTF-8 stays as it came."""
    if reserved not in ("keep", "reject"):
        raise ValueError("reserved must be 'keep' or 'reject'")
    raw = F.col("value").cast("binary")
    ends_in_return = F.substring(raw, -1, 1) == F.lit(bytearray(b"\r"))
    shorter = F.substring(raw, F.lit(1), F.octet_length(raw) - 1)
    stripped = lines.withColumn("value", F.when(ends_in_return, shorter).otherwise(raw))
    reason = F.when(F.octet_length("value") > max_line, "line_too_long")
    if reserved == "reject":
        reason = reason.when(F.substring("value", 1, 1) == F.lit(bytearray(b"\0")), "reserved_line")
    judged = stripped.withColumn("reason", reason)
    fixed = {
        "listener": F.lit(listener),
        "transport": F.lit("tcp"),
        "ts": F.lit(None).cast("timestamp"),
        "sender_host": F.lit(None).cast("string"),
        "sender_port": F.lit(None).cast("int"),
        "msg_id": F.lit(None).cast("int"),
        "fragment_count": F.lit(None).cast("int"),
        "tags": F.array().cast("array<string>"),
        "payload": F.col("value"),
    }
    messages = judged.where(F.col("reason").isNull()).select(
        *[fixed[name].alias(name) for name in MESSAGE_COLUMNS]
    )
    rejects = judged.where(F.col("reason").isNotNull()).select(
        F.lit(listener).alias("listener"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit(None).cast("bigint").alias("seq"),
        "reason",
        F.col("value").alias("data"),
    )
    return messages, rejects


def read_listeners(
    spark: SparkSession, listeners: dict[str, dict], defaults: dict | None = None
) -> DataFrame:
    """Datagrams of several listeners. Each has its own arguments of :func:`read_packets`,
    which fall back to ``defaults``."""
    return union_listeners(
        *[
            read_packets(spark, listener=name, **{**(defaults or {}), **own})
            for name, own in listeners.items()
        ]
    )


def union_listeners(*inputs: DataFrame) -> DataFrame:
    """Several listeners' tables as one; each keeps its name in ``listener``."""
    return reduce(DataFrame.unionByName, inputs)
