import json

from conftest import fragment, murmur3
from pyspark.sql import functions as F

from wirelog.operators.decode import valid_fragments
from wirelog.operators.defrag import defragment
from wirelog.operators.stats import (
    counters,
    dropped_histogram,
    loss_histogram_2d,
    size_profile,
    stats_json,
    triangle,
)
from wirelog.plans.decode_capture import decode_capture, decode_listeners
from wirelog.plans.handlers import Reverse, Truncate, apply_handlers, handlers_column
from wirelog.streaming.stats import rate


def test_loss_histogram_golden(spark):
    cells = [(0, 1, 1), (1, 2, 2), (2, 3, 3), (2, 4, 4), (0, 8, 5), (6, 10, 6)]
    rows = [("udp", i, n) for i, n, times in cells for _ in range(times)]
    frame = spark.createDataFrame(rows, "listener string, fragment_index int, fragment_count int")
    lines = triangle(loss_histogram_2d(frame)).first().histogram
    assert [len(line) for line in lines] == list(range(1, 18))
    filled = {(r, c): n for r, line in enumerate(lines) for c, n in enumerate(line) if n}
    assert filled == {(0, 0): 1, (1, 1): 2, (2, 2): 7, (3, 0): 5, (4, 3): 6}


def test_cells_right_of_the_diagonal_stay_in_the_long_form(spark):
    frame = spark.createDataFrame([("udp", 9, 2)], "listener string, fragment_index int, fragment_count int")
    long = loss_histogram_2d(frame)
    assert long.first().fragments == 1
    assert sum(map(sum, triangle(long).first().histogram)) == 0


def test_counters(packets_of):
    datagrams = [b"text", b"\7", b"\0\7", b"\0\0ping", b"\0\0KILL", b"\0\0burp", b"\0\0yo", b"", b"\0"]
    datagrams += [
        b"\0\1short",
        fragment(0, 0, 1, 1, 1, 1, b""),
        fragment(1, 0, 1, 1, 1, 1, b"", b"ab")[:-1],
        fragment(1, 0, 1, 1, 1, 1, b"a"),
    ]
    row = counters(packets_of([(9, n, d) for n, d in enumerate(datagrams)])).first()
    assert row.asDict() == {
        "listener": "udp",
        "udp_simple_messages": 1,
        "udp_invalid_version": 1,
        "v0_invalid_type": 1,
        "v0_invalid_multipart_header": 2,
        "unknown_command": 2,
        "v0_commands": 1,
        "exceptions": 3,
        "v0_multipart_fragments": 1,
    }


def _capture(packets_of):
    whole = murmur3(b"abcd")
    rows = [
        (9, 0, b"plain"),
        (9, 1, fragment(1, 0, 2, 1, 2, murmur3(b"hi"), b"hi")),
        (9, 2, fragment(1, 0, 2, 2, 2, 1, b"hi")),
        (9, 3, fragment(2, 0, 2, 3, 4, whole, b"ab")),
        (9, 4, fragment(2, 1, 2, 3, 4, whole, b"cd", b"t")),
        (9, 5, fragment(2, 1, 2, 3, 4, whole, b"cd")),
        (9, 6, fragment(3, 0, 2, 4, 6, 1, b"ab")),
        (9, 7, fragment(3, 1, 3, 4, 6, 1, b"abc")),
        (9, 8, b"\7"),
        (9, 9, fragment(0, 0, 1, 1, 1, 1, b"")),
    ]
    return packets_of(rows)


def test_whole_capture(spark, packets_of, tmp_path):
    for options in ({}, {"fragments_path": str(tmp_path / "fragments")}):
        capture = decode_capture(_capture(packets_of), hot_key_rows=2, **options)
        found = {bytes(r.payload): r.tags for r in capture.messages.collect()}
        assert found == {b"plain": [], b"hi": [], b"abcd": ["t"]}
        reasons = sorted(r.reason for r in capture.rejects.collect())
        assert reasons == ["checksum", "invalid_fragment", "invalid_version", "late_duplicate", "zero_count"]
        assert sorted(r.fragment_index for r in capture.missing.collect()) == [1, 2]
        assert sorted(r.msg_id for r in capture.ids.collect()) == [1, 2, 3, 4]


def test_statistics_document(spark, packets_of):
    capture = decode_capture(_capture(packets_of))
    shown = json.loads(stats_json(capture.statistics).first().stats)
    assert shown["v0_multipart_messages"] == 2 and shown["udp_simple_messages"] == 1
    assert shown["v0_invalid_checksum"][0] == 1 and sum(shown["v0_fragments"]) == 7
    assert shown["v0_invalid_fragments"][2][1] == 1
    assert shown["dropped_fragments"][2][1:3] == [1, 1]
    assert shown["defragmenter"] == {"evictions": 1, "hits": 2, "misses": 2}
    assert shown["handlers"] == []
    assert shown["holes_from_new_message"] == shown["holes_from_dead_port"] == 0  # ids 1 to 4


def _singles(packets_of, ids, port=9):
    return packets_of([(port, n, fragment(1, 0, 2, i, 2, murmur3(b"hi"), b"hi")) for n, i in enumerate(ids)])


def test_holes_reach_the_document(spark, packets_of):
    packets = _singles(packets_of, range(3, 120, 3))
    found = json.loads(stats_json(decode_capture(packets).statistics).first().stats)
    # 39 ids, 38 gaps of 2; the ten ids still remembered at the end hold nine of them
    assert (found["holes_from_new_message"], found["holes_from_dead_port"]) == (58, 18)
    off = json.loads(stats_json(decode_capture(packets, detect_holes=False).statistics).first().stats)
    assert (off["holes_from_new_message"], off["holes_from_dead_port"]) == (0, 0)


def test_listeners_have_their_own_settings(spark, packets_of):
    whole = murmur3(b"abcd")
    halves = [(9, 0, fragment(2, 0, 2, 3, 4, whole, b"ab")), (9, 5000, fragment(2, 1, 2, 3, 4, whole, b"cd"))]
    packets = packets_of(halves)
    both = packets.unionByName(packets.withColumn("listener", F.lit("quick")))
    capture = decode_listeners(both, {"quick": {"expire": "1 second", "detect_holes": False}}, {"expire": "10 seconds"})
    assert [(r.listener, bytes(r.payload)) for r in capture.messages.collect()] == [("udp", b"abcd")]
    rows = {r.listener: r.defragmenter.evictions for r in capture.statistics.collect()}
    assert rows == {"quick": 2, "udp": 0}


def test_listeners_stored_apart(spark, packets_of, tmp_path):
    """The capture is stored once by listener; fragments of each lie in a folder of their own."""
    packets = _capture(packets_of)
    both = packets.unionByName(packets.withColumn("listener", F.lit("quick/1")))
    both = both.unionByName(packets.withColumn("listener", F.lit(None).cast("string")))
    settings = {"quick/1": {"expire": "1 second"}, "udp": {}}
    plain = decode_listeners(both, settings, {"detect_holes": False})
    stored = decode_listeners(both, settings, {"detect_holes": False, "fragments_path": str(tmp_path / "kept")})
    for table in ("messages", "rejects", "commands", "statistics"):
        rows = [sorted(map(str, getattr(capture, table).drop("ts").collect())) for capture in (plain, stored)]
        assert rows[0] == rows[1] and (rows[0] or table == "commands"), table


def test_dropped_histogram_equals_listing(spark):
    rows = [("udp", n, sorted(set(range(0, n, k)) - {0})) for n, k in [(2, 1), (9, 2), (300, 7), (65535, 1000)]]
    frame = spark.createDataFrame(rows, "listener string, n int, indices array<int>").select(
        "listener", "indices", F.struct(F.col("n").alias("fragment_count")).alias("first_header"), F.size("indices").alias("received")
    )
    expected = {}
    for _, n, indices in rows:
        for i in set(range(n)) - set(indices):
            cell = ((n - 1).bit_length(), i.bit_length())
            expected[cell] = expected.get(cell, 0) + 1
    found = {(r.count_log2, r.index_log2): r.fragments for r in dropped_histogram(frame).collect()}
    assert found == expected


def test_handlers_stand_in_the_document(spark, packets_of):
    capture = decode_capture(_capture(packets_of))
    chain = apply_handlers(capture.messages, [Truncate(1), Reverse()])
    assert chain.messages.count() == 3
    shown = json.loads(stats_json(capture.statistics, handlers_column(chain.stats())).first().stats)
    assert shown["handlers"] == [{"name": "truncate", "seen_messages": 3}, {"name": "reverse"}]


def test_size_profile(spark):
    row = size_profile(spark.range(1, 101).withColumnRenamed("id", "size"), "size", exact=True).first()
    assert (row.n, row.smallest, row.largest, row.total, row.p50) == (100, 1, 100, 5050, 50.5)
    rough = size_profile(spark.range(1, 101).withColumnRenamed("id", "size"), "size").first()
    assert rough.p50 in (50, 51)


def test_sliding_rate_equals_direct_windows(spark):
    rows = spark.range(500).select(
        F.concat(F.lit("t"), F.col("id") % 3).alias("topic"),
        F.timestamp_micros(F.pmod(F.hash("id"), F.lit(3600)).cast("bigint") * 1000000).alias("ts"),
    )
    found = rate(rows, "15 minutes").select("topic", "window_start", "messages")
    direct = rows.groupBy("topic", F.window("ts", "15 minutes", "1 minute").alias("w")).count()
    expected = direct.select("topic", F.col("w.start"), F.col("count"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_fragment_rows_keep_only_what_is_read(spark, packets_of, tmp_path):
    """Without the payload in the output no stage past the scan carries it."""
    path = str(tmp_path / "fragments")
    valid_fragments(_capture(packets_of)).write.parquet(path)
    plan = defragment(spark.read.parquet(path)).incomplete._jdf.queryExecution().executedPlan()
    scan = [line for line in plan.toString().splitlines() if "FileScan" in line]
    assert scan and all("payload#" not in line for line in scan)
