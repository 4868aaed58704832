import time

import pytest
from conftest import fragment, murmur3
from pyspark.sql import functions as F
from test_defrag import _model, _random_rows
from test_holes import _scan_model

from wirelog.operators.decode import valid_fragments
from wirelog.schemas import PACKETS
from wirelog.sources.readers import read_packets
from wirelog.sources.sinks import fan_out_stream
from wirelog.streaming.defrag import defragment_session, defragment_stream
from wirelog.streaming.holes import holes_stream
from wirelog.streaming.run import run_available
from wirelog.streaming.stats import stats_stream

END = 10_000_000


def _in_batches(rows, path, pieces):
    """One file per piece of the arrival order, each newer than the one before."""
    top = rows.agg(F.max("seq")).first()[0] + 1
    for n in range(pieces):
        lower, upper = n * top // pieces, (n + 1) * top // pieces
        rows.where(F.col("seq").between(lower, upper - 1)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def _fragment_stream(spark, packets_of, rows, path, pieces):
    _in_batches(packets_of([*rows, (99, END, b"\0\1" + b"\0" * 22)]), path, pieces)
    # The closing row: a fragment of its own, far later.
    closing = packets_of([(99, END, fragment(2, 0, 1, 1, 2, 0, b"x"))]).withColumn("seq", F.lit(10**6))
    closing.withColumn("seq", F.col("seq").cast("bigint")).coalesce(1).write.mode("append").parquet(path)
    packets = read_packets(spark, path, streaming=True, maxFilesPerTrigger="1")
    return valid_fragments(packets)


@pytest.mark.parametrize("pieces", [1, 4])
def test_stream_equals_model(spark, packets_of, tmp_path, pieces):
    rows = _random_rows(11, rows=200)
    parsed = valid_fragments(packets_of(rows)).withColumn("us", F.unix_micros("ts"))
    messages, incomplete, invalid, late = _model(parsed.orderBy("seq").collect(), 1000)
    stream = _fragment_stream(spark, packets_of, rows, str(tmp_path / "in"), pieces)
    found = run_available(defragment_stream(stream, "1 second"), "out").where("sender_port <> 99")
    by_kind = {}
    for row in found.collect():
        by_kind.setdefault(row.kind, []).append(row)
    key = lambda r: (r.sender_port, r.msg_id)
    assert sorted((*key(r), bytes(r.payload), tuple(r.tags)) for r in by_kind["message"]) == sorted(
        (m[0], m[1], m[3], m[4]) for m in messages
    )
    assert sorted((*key(r), tuple(r.missing)) for r in by_kind["incomplete"]) == sorted(
        (i[0], i[1], i[4]) for i in incomplete
    )
    assert len(by_kind["invalid"]) == len(invalid)
    assert len(by_kind["late_duplicate"]) == len(late)


def test_stream_replica_opens_phantoms(spark, packets_of, tmp_path):
    digest = murmur3(b"ab")
    a, b = fragment(2, 0, 1, 7, 2, digest, b"a"), fragment(2, 1, 1, 7, 2, digest, b"b")
    stream = _fragment_stream(spark, packets_of, [(9, 5, a), (9, 6, b), (9, 7, a)], str(tmp_path / "in"), 2)
    found = run_available(defragment_stream(stream, "1 second", compat=True), "out")
    kinds = sorted(r.kind for r in found.where("sender_port = 9").collect())
    assert kinds == ["incomplete", "message"]


def test_neighbouring_ids_share_a_state_row(spark, packets_of, tmp_path):
    """Python is called, and state kept, for groups of ids and not for every one."""
    digest = murmur3(b"ab")
    halves = [(9, n, fragment(2, n % 2, 1, n // 2, 2, digest, b"ab"[n % 2 : n % 2 + 1])) for n in range(640)]
    path = str(tmp_path / "in")
    packets_of(halves).coalesce(1).write.parquet(path)
    outcomes = defragment_stream(valid_fragments(read_packets(spark, path, streaming=True)), "1 second")
    writer = outcomes.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(kept) <= 20


def test_ids_of_one_group_expire_each_by_its_own_lease(spark, packets_of, tmp_path):
    """Ids 1 to 3 are neighbours: one is never whole, one is, and one comes again after its lease."""
    digest = murmur3(b"ab")
    a, b = (lambda m, i=i: fragment(2, i, 1, m, 2, digest, b"ab"[i : i + 1]) for i in (0, 1))
    rows = [(9, 5, a(1)), (9, 6, a(2)), (9, 7, a(3)), (9, 900, b(2)), (9, 2500, a(3)), (9, 2600, b(3)), (9, 2700, b(2))]
    for pieces in (1, 7):
        stream = _fragment_stream(spark, packets_of, rows, str(tmp_path / f"in{pieces}"), pieces)
        found = run_available(defragment_stream(stream, "1 second"), "out").where("sender_port = 9")
        assert sorted((r.msg_id, r.kind, r.us) for r in found.collect()) == [
            (1, "incomplete", 5000),
            (2, "incomplete", 2_700_000),
            (2, "message", 900_000),
            (3, "incomplete", 7000),
            (3, "message", 2_600_000),
        ]


@pytest.mark.parametrize("pieces", [1, 3])
def test_session_equals_model(spark, packets_of, tmp_path, pieces):
    rows = _random_rows(12, rows=200)
    parsed = valid_fragments(packets_of(rows)).withColumn("us", F.unix_micros("ts"))
    messages, incomplete, _, late = _model(parsed.orderBy("seq").collect(), 1000)
    stream = _fragment_stream(spark, packets_of, rows, str(tmp_path / "in"), pieces)
    found = run_available(defragment_session(stream, "1 second"), "out").where("sender_port <> 99")
    done, partial, repeats = [], [], 0
    for row in found.collect():
        repeats += row.late_duplicates
        if row.complete:
            done.append((row.sender_port, row.msg_id, bytes(row.payload), tuple(row.tags)))
        else:
            partial.append((row.sender_port, row.msg_id, tuple(row.missing)))
    assert sorted(done) == sorted((m[0], m[1], m[3], m[4]) for m in messages)
    assert sorted(partial) == sorted((i[0], i[1], i[4]) for i in incomplete)
    assert repeats == len(late)


@pytest.mark.parametrize("pieces", [1, 3])
def test_holes_stream_equals_model(spark, ids_of, tmp_path, pieces):
    step = [1, 1, 2, 4, 1, 40, 1, 3, -2, 1]
    at, rows = {1: 0, 2: 0}, []
    for n in range(200):
        port = 1 + n % 2
        at[port] += step[n * 7 % 10]
        rows.append((port, at[port], 5000 + n * 1000 + (3_000_000 if n > 120 else 0)))
    expected = _scan_model(sorted(rows, key=lambda r: (r[0], r[2])), 1_000_000, 5, 10)
    expected = sorted((p, k, h) for p, _, k, _, _, h in expected if h)
    path = str(tmp_path / "ids")
    ids = ids_of([*rows, (99, 1, END * 1000)])
    _in_batches(ids, path, pieces)
    stream = spark.readStream.schema(ids.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = run_available(holes_stream(stream, "1 second", 5, 10), "out")
    assert sorted((r.sender_port, r.kind, r.holes) for r in found.collect()) == expected


def test_windowed_counters(spark, packets_of, tmp_path):
    rows = [(9, n * 100, [b"text", b"\7"][n % 2]) for n in range(40)] + [(9, END, b"x")]
    path = str(tmp_path / "in")
    _in_batches(packets_of(rows), path, 3)
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(path)
    found = run_available(stats_stream(stream, "1 second"), "out")
    rows = found.orderBy("window.start").collect()
    assert [(r.udp_simple_messages, r.udp_invalid_version) for r in rows] == [(5, 5)] * 4


def test_fan_out_of_a_stream(spark, packets_of, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    _in_batches(packets_of([(9, n, b"m") for n in range(6)]), path, 2)
    stream = spark.readStream.schema(PACKETS).parquet(path)
    sinks = [(lambda df, n=n: df.write.mode("append").parquet(f"{out}/{n}"), True) for n in "ab"]
    writer = fan_out_stream(stream, sinks, str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert [spark.read.parquet(f"{out}/{n}").count() for n in "ab"] == [6, 6]
