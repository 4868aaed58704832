import pytest
from conftest import fragment, murmur3
from pyspark.sql import functions as F

from wirelog.operators.decode import (
    classify_packets,
    header_rejects,
    numeric_message_key,
    packet_rejects,
    parse_commands,
    simple_messages,
    valid_fragments,
)
from wirelog.operators.defrag import reassemble
from wirelog.operators.encode import assign_message_ids, chunk, packetize, packetize_rejects


def test_classification(packets_of):
    simple = [b" "] + [bytes([b]) for b in range(32, 256)]
    versions = [bytes([b, 1]) for b in range(1, 32)]
    types = [bytes([0, b]) for b in range(2, 256)]
    rows = simple + versions + types + [b"", b"\0", b"\0\0ping", b"\0\1"]
    packets = packets_of([(9, n, d) for n, d in enumerate(rows)])
    kinds = dict(classify_packets(packets).groupBy("kind").count().collect())
    assert kinds == {
        "simple": 225,
        "invalid_version": 31,
        "invalid_type": 254,
        "decode_error": 2,
        "command": 1,
        "fragment": 1,
    }
    assert simple_messages(packets).count() == 225
    assert packet_rejects(packets).count() == 31 + 254 + 2


def test_commands(packets_of):
    datagrams = [b"\0\0borg", b"\0\0assimilation", b"\0\0yo", b"\0\0PiNgfor7", b"\0\0kill"]
    rows = parse_commands(packets_of([(9, n, d) for n, d in enumerate(datagrams)]))
    found = [
        (r.command, r.trail and bytes(r.trail), r.known) for r in rows.orderBy("seq").collect()
    ]
    assert found == [
        ("BORG", found[0][1], False),
        ("ASSI", b"milation", False),
        (None, None, False),
        ("PING", b"for7", True),
        ("KILL", found[4][1], True),
    ]
    assert not found[0][1] and not found[4][1]


def test_header_golden(packets_of):
    data = bytes.fromhex("0001050403020607" + "08090a0b" + "0c0d0e0f" + "10111213" + "00000000")
    row = valid_fragments(packets_of([(9, 0, data)])).select(
        "*", numeric_message_key().alias("key")
    ).first()
    assert (row.fragment_count, row.fragment_index, row.fragment_size) == (1284, 770, 1543)
    assert (row.key, row.total_length, row.msg_hash) == (38789515787, 202182159, 269554195)
    assert row.tags is None and bytes(row.payload) == b""


def test_header_rejects(packets_of):
    cases = {
        "short_header": fragment(1, 0, 1, 1, 1, 1, b"")[:23],
        "zero_count": fragment(0, 0, 1, 1, 1, 1, b""),
        "index_out_of_range": fragment(2, 2, 1, 1, 1, 1, b""),
        "negative_length": fragment(1, 0, 1, 1, -1, 1, b""),
        "tags_overrun": fragment(1, 0, 1, 1, 1, 1, b"", b"ab")[:-1],
    }
    packets = packets_of([(9, n, d) for n, d in enumerate(cases.values())])
    found = [r.reason for r in header_rejects(packets).orderBy("seq").collect()]
    assert found == list(cases)
    assert valid_fragments(packets).count() == 0


def _messages(spark, rows):
    frame = spark.createDataFrame(
        [(i, bytearray(p), t) for i, (p, t) in enumerate(rows, 1)],
        "msg_id int, payload binary, tags array<string>",
    )
    return frame.select(
        F.lit("udp").alias("listener"),
        F.timestamp_micros(F.col("msg_id") * 1000).alias("ts"),
        F.col("msg_id").cast("bigint").alias("seq"),
        F.lit("192.0.2.1").alias("sender_host"),
        F.lit(9).alias("sender_port"),
        "msg_id",
        "tags",
        "payload",
    )


def test_encoded_packet_golden(spark):
    row = chunk(_messages(spark, [(b"abc", None)])).first()
    expected = "00010001000 0fa00 00000001 00000003 b3dd93fa 00000000 616263".replace(" ", "")
    assert bytes(row.data).hex() == expected


@pytest.mark.parametrize("size", [25, 40, 60])
def test_round_trip(spark, size):
    payloads = [bytes(range(n % 256)) * (n // 256 + 1) for n in (1, 2, 3, 6, 21, 51, 101, 201)]
    tag_sets = [None] if size == 25 else [None, ["foo"], ["foo", "bar"]]
    rows = [(p, t) for p in payloads for t in tag_sets]
    messages = _messages(spark, rows)
    refused = packetize_rejects(messages, size)
    back = reassemble(valid_fragments(packetize(messages, size)))
    found = {r.msg_id: (bytes(r.payload), r.tags) for r in back.where("checksum_ok").collect()}
    gone = {r.seq: r.reason for r in refused.collect()}
    assert set(gone.values()) <= {"tags_spill"}
    expected = {
        n: (p, t or []) for n, (p, t) in enumerate(rows, 1) if n not in gone
    }
    assert found == expected
    for number in gone:
        payload, tags = rows[number - 1]
        room, extra = size - 24, len("\0".join(tags))
        count = -(-(len(payload) + extra) // room)
        assert len(payload) < (count - 1) * room


def test_unsendable(spark):
    rows = [(b"", None), (b"x", ["t" * 30]), (b"x" * 70000, None)]
    found = packetize_rejects(_messages(spark, rows), 25).orderBy("seq").collect()
    assert [r.reason for r in found] == ["empty", "tags_too_large", "too_many_fragments"]
    with pytest.raises(ValueError):
        packetize(_messages(spark, rows), 24)
    for options in ({"max_fragment_size": 65560}, {"max_fragment_size": 99, "size_field": 65536}):
        with pytest.raises(ValueError):
            packetize(_messages(spark, rows), **options)


def test_chunks(spark):
    text = b"twenty bytes of text, and more"
    rows = _messages(spark, [(b"12345678", None), (text, None), (b"", None)])
    eight = valid_fragments(chunk(rows.where("msg_id <> 2"), 8)).collect()
    assert [(r.msg_id, bytes(r.payload)) for r in eight] == [(1, b"12345678")]
    twenty = valid_fragments(chunk(rows.where("msg_id = 2"), 20)).orderBy("fragment_index")
    assert [bytes(r.payload) for r in twenty.collect()] == [text[:20], text[20:]]
    for bad in (0, 65483):
        with pytest.raises(ValueError):
            chunk(rows, bad)


def test_message_ids_are_dense_for_a_hot_sender(spark):
    rows = spark.range(5000).select(
        F.lit("udp").alias("listener"),
        F.lit("h").alias("sender_host"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("int").alias("sender_port"),
        F.timestamp_micros(F.pmod(F.hash("id"), F.lit(1000)).cast("bigint")).alias("ts"),
        F.col("id").alias("seq"),
    )
    found = assign_message_ids(rows).orderBy("sender_port", "ts", "seq").collect()
    seen = {}
    for row in found:
        seen[row.sender_port] = seen.get(row.sender_port, 0) + 1
        assert row.msg_id == seen[row.sender_port]


def test_single_fragment_needs_no_valid_size(packets_of):
    data = fragment(1, 0, 99, 5, 77, murmur3(b"hi"), b"hi", b"a\0b")
    row = reassemble(valid_fragments(packets_of([(9, 0, data)]))).first()
    assert row.checksum_ok and bytes(row.payload) == b"hi" and row.tags == ["a", "b"]
