import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def packets_of(spark):
    """Packets from (port, milliseconds, bytes) rows, in that order of arrival."""

    def build(rows):
        numbered = [(p, ms * 1000, n, bytearray(d)) for n, (p, ms, d) in enumerate(rows)]
        frame = spark.createDataFrame(numbered, "sender_port int, us bigint, seq bigint, data binary")
        return frame.select(
            F.lit("udp").alias("listener"),
            F.timestamp_micros("us").alias("ts"),
            "seq",
            F.lit("192.0.2.1").alias("sender_host"),
            "sender_port",
            "data",
        )

    return build


@pytest.fixture
def ids_of(spark):
    """Ids from (port, id, microseconds) rows, in that order of arrival."""

    def build(rows):
        numbered = [(p, i, us, n) for n, (p, i, us) in enumerate(rows)]
        frame = spark.createDataFrame(
            numbered, "sender_port int, msg_id int, us bigint, seq bigint"
        )
        return frame.select(
            F.lit("udp").alias("listener"),
            F.lit("192.0.2.1").alias("sender_host"),
            "sender_port",
            "msg_id",
            F.timestamp_micros("us").alias("ts"),
            "seq",
        )

    return build


def fragment(count, index, size, msg_id, length, digest, payload, tags=b""):
    """One datagram, written independently of the library."""
    header = b"\x00\x01"
    for value, width in [(count, 2), (index, 2), (size, 2)]:
        header += value.to_bytes(width, "big")
    for value in (msg_id, length, digest):
        header += (value & 0xFFFFFFFF).to_bytes(4, "big")
    return header + len(tags).to_bytes(2, "big") + b"\x00\x00" + tags + payload


def murmur3(data, seed=0):
    """Plain MurmurHash3 x86_32, as published."""
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    h = seed
    for start in range(0, len(data), 4):
        block = data[start : start + 4]
        k = int.from_bytes(block, "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= rotl(k, 15) * 0x1B873593 & 0xFFFFFFFF
        if len(block) == 4:
            h = (rotl(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h
