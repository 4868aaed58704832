"""Packets derived from the driver's tables by integer rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelog.functions.binary import hex_digits, i32, slice_bytes
from wirelog.operators.encode import packetize
from wirelog.operators.ordering import with_rank

BASE_US = 1704067200000000  # 2024-01-01 00:00:00 UTC
FRAGMENT = 280
ROOM = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_messages(spark: SparkSession, sf_dir: str, tagged: bool = False) -> DataFrame:
    """One message per document; ids are dense per sender."""
    docs = table(spark, sf_dir, "documents")
    payload = F.encode("text", "UTF-8")
    tags = F.array(
        F.concat(F.lit("kt:"), F.col("source")), F.concat(F.lit("pk:"), F.col("lang"))
    )
    room_left = ROOM - F.pmod(F.octet_length(payload) - 1, F.lit(ROOM)) - 1
    fits = F.octet_length(F.encode(F.array_join(tags, "\0"), "UTF-8")) <= room_left
    none = F.array().cast("array<string>")
    return docs.select(
        F.lit("udp").alias("listener"),
        F.timestamp_micros(F.lit(BASE_US) + F.col("doc_id") * 1000000).alias("ts"),
        (F.col("doc_id") * 65536).alias("seq"),
        F.lit("192.0.2.1").alias("sender_host"),
        (F.lit(1024) + F.col("doc_id") % 16).cast("int").alias("sender_port"),
        F.call_function("div", F.col("doc_id"), F.lit(16)).cast("int").alias("msg_id"),
        (F.when(fits, tags).otherwise(none) if tagged else none).alias("tags"),
        payload.alias("payload"),
    )


def doc_id() -> Column:
    """The document a packet or message came from."""
    return F.col("msg_id").cast("bigint") * 16 + F.col("sender_port") - 1024


def document_packets(spark: SparkSession, sf_dir: str, tagged: bool = False) -> DataFrame:
    """Fragment datagrams of all documents, one millisecond apart."""
    packets = packetize(document_messages(spark, sf_dir, tagged), FRAGMENT)
    return (
        packets.withColumn("ts", shift(F.col("fragment_index") * 1000))
        .withColumn("seq", F.col("seq") + F.col("fragment_index"))
        .withColumn("doc_id", doc_id())
        .withColumn("fragment_count", F.conv(F.hex(slice_bytes("data", 2, 2)), 16, 10).cast("int"))
    )


def shift(micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros("ts") + micros)


def lost(packets: DataFrame) -> DataFrame:
    return packets.where((F.col("doc_id") * 31 + F.col("fragment_index")) % 97 != 0)


def _replace(start: int, width: int, digits: Column) -> Column:
    return F.concat(
        slice_bytes("data", 0, start),
        F.unhex(digits),
        slice_bytes("data", start + width, F.octet_length("data") - (start + width)),
    )


def corrupted(packets: DataFrame) -> DataFrame:
    """The header hash of some documents has its lowest bit flipped."""
    flipped = _replace(16, 4, hex_digits(i32("data", 16).bitwiseXOR(F.lit(1)), 4))
    hit = F.col("doc_id") % 53 == 0
    return packets.withColumn("data", F.when(hit, flipped).otherwise(F.col("data")))


def shortened(packets: DataFrame) -> DataFrame:
    """Index 1 of some documents lost its last byte."""
    hit = (
        (F.col("doc_id") % 41 == 0) & (F.col("fragment_count") > 2) & (F.col("fragment_index") == 1)
    )
    cut = slice_bytes("data", 0, F.octet_length("data") - 1)
    return packets.withColumn("data", F.when(hit, cut).otherwise(F.col("data")))


def repeated(packets: DataFrame) -> DataFrame:
    """Index 0 of some documents is sent again with its first byte zeroed: 500 microseconds
    later (before the message is complete) or one second later (after it)."""
    first = packets.where((F.col("fragment_index") == 0) & (F.col("fragment_count") > 1))
    zeroed = first.withColumn("data", _replace(24, 1, F.lit("00")))
    early = zeroed.where(F.col("doc_id") % 29 == 0).withColumn("ts", shift(F.lit(500)))
    late = zeroed.where(F.col("doc_id") % 31 == 0).withColumn("ts", shift(F.lit(1000000)))
    return packets.unionByName(early).unionByName(late)


def delayed(packets: DataFrame) -> DataFrame:
    """The last fragment of some documents comes eleven seconds late."""
    hit = (
        (F.col("doc_id") % 37 == 0)
        & (F.col("fragment_count") > 1)
        & (F.col("fragment_index") == F.col("fragment_count") - 1)
    )
    return packets.withColumn("ts", F.when(hit, shift(F.lit(11000000))).otherwise(F.col("ts")))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datagrams of every kind, by ``event_id % 8``."""
    kind = F.col("event_id") % 8
    text = F.col("event_type")

    def raw(prefix: str, body=None):
        head = F.unhex(F.lit(prefix))
        return head if body is None else F.concat(head, F.encode(body, "UTF-8"))

    data = (
        F.when(kind <= 1, F.encode(text, "UTF-8"))
        .when(kind == 2, raw("07", text))
        .when(kind == 3, raw("0009", text))
        .when(kind == 4, raw("0000", F.concat(F.lit("ping"), F.col("event_id").cast("string"))))
        .when(kind == 5, raw("0000", F.lit("burp")))
        .when(kind == 6, raw("0000", F.lit("yo")))
        .otherwise(raw("0001" + "00" * 22))
    )
    return event_rows(spark, sf_dir).select(
        F.concat(F.lit("udp"), (F.col("user_id") % 3).cast("string")).alias("listener"),
        "ts",
        F.col("event_id").alias("seq"),
        F.lit("192.0.2.2").alias("sender_host"),
        (F.col("user_id") % 60000 + 1024).cast("int").alias("sender_port"),
        data.alias("data"),
    )


def event_ids(
    spark: SparkSession, sf_dir: str, resets: bool = False, every: bool = False
) -> DataFrame:
    """Message ids per user with small holes; with ``resets`` a jump after the 40th id."""
    events = event_rows(spark, sf_dir).select("user_id", "ts", "event_id")
    ranked = with_rank(events, ["user_id"], ["ts", "event_id"], "rank")
    jump = F.when(F.col("rank") > 40, 1000).otherwise(0) if resets else F.lit(0)
    present = F.lit(True) if every else F.col("event_id") % 11 != 0
    return ranked.where(present).select(
        F.lit("udp").alias("listener"),
        F.lit("192.0.2.2").alias("sender_host"),
        F.col("user_id").cast("int").alias("sender_port"),
        (F.col("rank") + jump).cast("int").alias("msg_id"),
        "ts",
        F.col("event_id").alias("seq"),
    )
