import json

import pytest
from pyspark.sql import functions as F

from wirelog.operators.messages import format_messages, parse_events, split_events_by_type
from wirelog.operators.routing import assign_partition, decrypt, drop_null_topic, encrypt, route
from wirelog.plans.handlers import Reverse, Truncate, apply_handlers, handlers_column
from wirelog.sources.readers import lines_to_messages, read_lines
from wirelog.sources.sinks import count_sink, fan_out, kafka_rows


def _messages(spark, rows):
    frame = spark.createDataFrame(
        [(bytearray(p), t) for p, t in rows], "payload binary, tags array<string>"
    )
    return frame.withColumn("ts", F.timestamp_micros(F.lit(0).cast("bigint")))


def test_format(spark):
    rows = _messages(spark, [(b"foo", None), (b"foo", []), (b"foo", ["bar", "baz"])])
    assert [r.value for r in format_messages(rows).collect()] == ["foo", "foo", "[bar,baz] foo"]


def test_handler_chain(spark):
    chain = apply_handlers(_messages(spark, [(b"hello world", [])]), [Reverse(), Truncate(5)])
    assert bytes(chain.messages.collect()[0].payload) == b"dlrow"
    assert chain.stats() == [{"name": "reverse"}, {"seen_messages": 1, "name": "truncate"}]


def test_routing(spark):
    tags = [["x"], ["kt:a", "kt:b"], ["pk:1", "pk:2:3", "kt:"], ["kt:null", "pk:"], None]
    rows = route(_messages(spark, [(b"m", t) for t in tags]), "main")
    found = [(r.topic, r.key) for r in rows.collect()]
    assert found == [("main", None), ("b", None), ("", "2:3"), ("null", ""), ("main", None)]
    assert drop_null_topic(rows).count() == kafka_rows(rows).count() == 4
    placed = assign_partition(rows, 4).collect()
    assert [r.partition is None for r in placed] == [True, True, False, False, True]
    spread = assign_partition(rows, 4, spread=["topic"]).collect()
    assert all(0 <= r.partition < 4 for r in spread)


@pytest.mark.parametrize("mode,length", [("CBC", 32), ("GCM", 33)])
def test_encryption(spark, mode, length):
    rows = _messages(spark, [(b"hello", [])] * 2)
    sealed = encrypt(rows, "sixteen byte key", mode).cache()
    values = [bytes(r.payload) for r in sealed.collect()]
    assert [len(v) for v in values] == [length] * 2 and values[0] != values[1]
    assert [bytes(r.payload) for r in decrypt(sealed, "sixteen byte key", mode).collect()] == [b"hello"] * 2
    for key, wanted in [("short", mode), ("sixteen byte key", "ECB")]:
        with pytest.raises(ValueError):
            encrypt(rows, key, wanted)
    with pytest.raises(Exception):
        decrypt(sealed, "another key 1234", mode).collect()


def test_key_is_in_no_plan(spark):
    frame = encrypt(spark.createDataFrame([(bytearray(b"x"),)], "payload binary"), "0123456789abcdef")
    query = frame._jdf.queryExecution()
    frame.collect()
    for plan in (query.toString(), query.executedPlan().treeString(), query.logical().toJSON(), query.optimizedPlan().toJSON()):
        assert "0123456789abcdef" not in plan and "30313233" not in plan


def test_lines(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes("one\ntwo\r\n\nlonger é\n\0reserved\nend".encode())
    messages, rejects = read_lines(spark, str(path), max_line=8)
    assert sorted(bytes(r.payload) for r in messages.collect()) == sorted(
        [b"one", b"two", b"", b"end"]
    )
    assert sorted(bytes(r.data) for r in rejects.collect()) == sorted(
        ["longer é".encode(), b"\0reserved"]
    )
    messages, rejects = read_lines(spark, str(path), reserved="reject")
    assert [r.reason for r in rejects.collect()] == ["reserved_line"] and messages.count() == 5
    with pytest.raises(ValueError):
        lines_to_messages(spark.range(1).selectExpr("'' AS value"), "tcp", reserved="no")


def test_lines_keep_bytes_that_are_no_utf8(spark):
    rows = [(bytearray(b"caf\xe9 ok\r"),), (bytearray(b"\xff" * 8),), (bytearray(b"\r"),), (bytearray(b""),), (bytearray(b"\0x"),)]
    lines = spark.createDataFrame(rows, "value binary").select(F.col("value").cast("string").alias("value"))
    messages, rejects = lines_to_messages(lines, "tcp", max_line=7, reserved="reject")
    assert sorted(bytes(r.payload) for r in messages.collect()) == [b"", b"", b"caf\xe9 ok"]
    assert sorted((r.reason, bytes(r.data)) for r in rejects.collect()) == [
        ("line_too_long", b"\xff" * 8), ("reserved_line", b"\0x"),
    ]


def test_events(spark):
    good = {"type": "a", "uuid": "u", "host": "h", "timestamp": 1700000000123, "data": {"x": [1, "y"]}}
    texts = [json.dumps(good), json.dumps({**good, "type": "b"}), "{nonsense", "plain"]
    events = parse_events(_messages(spark, [(t.encode(), []) for t in texts])).cache()
    accepted, refused = split_events_by_type(events, ["a"])
    row = accepted.select("event.*", F.to_json("event.data").alias("j"), "event_time").collect()[0]
    assert json.loads(row.j) == good["data"] and row.host == "h"
    assert row.event_time.microsecond == 123000
    assert sorted(r.reason for r in refused.select("reason").collect()) == [
        "not_an_event",
        "not_an_event",
        "type_not_allowed",
    ]


def test_sinks(spark):
    rows = _messages(spark, [(b"m", [])] * 3)
    assert count_sink(rows) == 3
    seen = []
    sinks = [("a", True), ("b", False), ("c", True)]
    chain = [(lambda df, n=n: seen.append((n, df.count())), keep) for n, keep in sinks]
    fan_out(rows, chain)
    assert seen == [("a", 3), ("b", 3)]


def test_a_killed_sink_repeats_nothing(spark, tmp_path):
    """The second sink dies twice; afterwards each sink has each message once, computed once."""
    rows = _messages(spark, [(b"m%d" % n, []) for n in range(20)])
    computed = spark.sparkContext.accumulator(0)
    counting = F.udf(lambda x: computed.add(1) or x, "binary")
    rows = rows.withColumn("payload", counting("payload"))
    deaths = []

    def into(name):
        def write(messages):
            if name == "second" and len(deaths) < 2:
                deaths.append(1)
                raise OSError("disk gone")
            messages.select("payload").write.mode("append").parquet(f"{tmp_path}/{name}")

        write.__name__ = name
        return write

    chain = [(into("first"), True), (into("second"), True), (into("third"), True)]
    path = f"{tmp_path}/chain"
    with pytest.raises(OSError):
        fan_out(rows, chain, path)
    reports = fan_out(rows, chain, path, tolerant=True)
    assert [(r["name"], r["logged_messages"], r["failed_messages"]) for r in reports] == [
        ("first", 20, 0), ("second", 0, 20), ("third", 20, 0),
    ]
    for _ in range(2):
        fan_out(rows, chain, path)
    for name in ("first", "second", "third"):
        assert sorted(bytes(r.payload) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()) == sorted(
            b"m%d" % n for n in range(20)
        )
    assert computed.value == 20
    shown = json.loads(rows.limit(1).select(F.to_json(handlers_column(reports)).alias("j")).first().j)
    assert shown[1] == {"name": "second", "failed_messages": 20, "logged_messages": 0, "seen_messages": 20}


def test_fan_out_of_nothing(spark, tmp_path):
    rows = _messages(spark, [(b"m", [])]).limit(0)
    assert fan_out(rows, [(lambda df: df.count(), True)], str(tmp_path / "x"))[0]["seen_messages"] == 0
