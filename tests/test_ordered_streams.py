"""Streams that reorder: pure processors on a recorded state, and whole streams against the models."""

import random

import pytest
from conftest import fragment, murmur3
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_defrag import _model, _random_rows
from test_holes import _scan_model

from wirelog.operators.decode import valid_fragments
from wirelog.sources.readers import read_packets
from wirelog.streaming.ordered import IdWatcher, Reassembler, defragment_in_order, holes_in_order, state_store
from wirelog.streaming.run import run_available

END = 60_000_000


class Value:
    def __init__(self, log):
        self.log, self.value = log, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.log.append(sum(len(v) if isinstance(v, (bytes, list)) else 8 for v in value if v is not None))
        self.value = value

    def clear(self):
        self.value = None


class Map(dict):
    def __init__(self, log):
        self.log = log

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.log.append(sum(len(v) if isinstance(v, (bytes, list)) else 8 for v in value if v is not None))
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    """Records the bytes of every write."""

    def __init__(self):
        self.written, self.timers = [], set()

    def getValueState(self, name, schema):
        return Value(self.written)

    def getMapState(self, name, key, value):
        return Map(self.written)

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("count", [10, 300])
def test_an_arrival_writes_its_own_piece_only(count):
    handle, processor = Handle(), Reassembler(1_000_000)
    processor.key_names = ["msg_id", "sender_port", "sender_host", "listener"]
    processor.init(handle)
    names = ["listener", "sender_host", "sender_port", "msg_id", "fragment_count", "fragment_index",
             "fragment_size", "total_length", "msg_hash", "tags", "payload", "us", "seq"]
    key, found = (1, 2, "h", "udp"), []
    for n in range(count):
        values = ("udp", "h", 2, 1, count, n, 100, 100 * count, 0, None, b"x" * 100, 1000 * n, n)
        assert not list(processor.handleInputRows(key, iter([Row(*names)(*values)]), Clock(max(n - 1, 0))))
        found += processor.handleExpiredTimer(key, Clock(n), None)
    assert [row[4] for row in found] == ["message"] and found[0][-1] == b"x" * 100 * count
    assert max(handle.written) < 300  # one row or one piece, whatever is held already
    assert len(handle.written) <= 3 * count
    found = list(processor.handleExpiredTimer(key, Clock(count + 1000), None))
    assert not found and not processor.header.exists() and not processor.pieces


def test_messages_whole_at_once_write_no_piece():
    """Neighbouring ids of one call: a chunk per 64 rows, and one row of headers."""
    handle, processor = Handle(), Reassembler(1_000_000)
    processor.key_names = ["id_group", "sender_port", "sender_host", "listener"]
    processor.init(handle)
    names = ["listener", "sender_host", "sender_port", "msg_id", "fragment_count", "fragment_index",
             "fragment_size", "total_length", "msg_hash", "tags", "payload", "us", "seq"]
    rows = [Row(*names)("udp", "h", 2, m, 10, n, 1, 10, 0, None, b"%d" % n, 1000 * n, 32 * n + m)
            for m in range(32) for n in range(10)]
    random.Random(3).shuffle(rows)
    assert not list(processor.handleInputRows((0, 2, "h", "udp"), iter(rows), Clock(0)))
    found = list(processor.handleExpiredTimer((0, 2, "h", "udp"), Clock(100), None))
    assert sorted((row[3], row[4], row[-1]) for row in found) == [(m, "message", b"0123456789") for m in range(32)]
    assert len(handle.written) <= 320 // 64 + 1 and not processor.pieces and not processor.waiting


@pytest.mark.parametrize("seed", range(5))
def test_ids_wait_in_chunks_and_leave_in_order(seed):
    """Rows of several calls overlap in time and repeat moments; the watermark cuts chunks."""
    rnd, handle, processor = random.Random(seed), Handle(), IdWatcher(10**12, 5, 10)
    processor.init(handle)
    taken = []
    processor.take = lambda us, row: taken.append((us, row.seq, row.msg_id))
    rows, watermark, arrived = [], 0, []
    for call in range(6):
        batch = [(1000 * watermark + 1 + rnd.randrange(40_000), rnd.randrange(3), 1000 * call + n) for n in range(150)]
        arrived += batch
        given = [Row("msg_id", "seq", "us", "sender_port")(msg_id, seq, us, msg_id % 32) for us, seq, msg_id in batch]
        assert not list(processor.handleInputRows(("udp", "h", 0), iter(given), Clock(watermark)))
        watermark += 15
        list(processor.handleExpiredTimer(("udp", "h", 0), Clock(watermark), None))
        rows = sorted((row for row in arrived if row[0] <= 1000 * watermark), key=lambda row: row[:2])
        assert taken == rows
    assert rows and len(handle.written) < len(arrived) / 8


def test_micro_batches_are_computed_once_and_in_parallel(spark, ids_of):
    """Rows come from one pass over their source, and no micro-batch is written by a single task."""
    from catalog.stream_queries import out_of_order

    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    ids = ids_of([(n % 7, n, 1_000_000 * n) for n in range(400)]).repartition(4)
    rows = ids.mapInArrow(counted, ids.schema)
    stream = out_of_order(spark, rows, "once", 100_000_000)
    assert passes.value <= 2 * 400  # the earliest moment, and the rows
    found = run_available(stream.select("seq", F.input_file_name().alias("file")), "seen")
    assert sorted(row.seq for row in found.collect()) == list(range(400))
    assert found.select("file").distinct().count() > 5


def _shuffled(rows, path, batches, seed):
    """Files in the order of reading; a row may be in any."""
    import time

    spread = rows.withColumn("_in", F.pmod(F.hash("seq", F.lit(seed)), F.lit(batches)))
    for n in range(batches):
        spread.where(F.col("_in") == n).drop("_in").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    state_store(spark)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("seed", [1, 2])
def test_reassembly_of_shuffled_batches_equals_model(spark, packets_of, tmp_path, rocks, seed):
    rows = _random_rows(11, rows=160)
    parsed = valid_fragments(packets_of(rows)).withColumn("us", F.unix_micros("ts"))
    messages, incomplete, invalid, late = _model(parsed.orderBy("seq").collect(), 1000)
    path = str(tmp_path / "in")
    _shuffled(packets_of(rows), path, 4, seed)
    closing = packets_of([(99, END, fragment(2, 0, 1, 1, 2, 0, b"x"))]).withColumn("seq", F.lit(10**6).cast("bigint"))
    closing.coalesce(1).write.mode("append").parquet(path)
    stream = valid_fragments(read_packets(spark, path, streaming=True, maxFilesPerTrigger="1"))
    found = run_available(defragment_in_order(stream, "1 second", "9 seconds"), "out").where("sender_port <> 99")
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


def test_ids_of_shuffled_batches_equal_model(spark, ids_of, tmp_path, rocks):
    rnd = random.Random(4)
    now, at, rows = 0, {p: 0 for p in range(2)}, []
    for _ in range(300):
        port = rnd.choice([0, 0, 0, 1])
        now += 2_000_000 if rnd.random() < 0.02 else rnd.choice([0, 1, 1000])
        at[port] += rnd.choice([1, 1, 1, 2, 4, -2, 30])
        rows.append((port, at[port], now))
    path = str(tmp_path / "ids")
    _shuffled(ids_of(rows), path, 3, 7)
    ids_of([(99, 1, now + 60_000_000)]).withColumn("seq", F.lit(10**6).cast("bigint")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ids_of(rows).schema).option("maxFilesPerTrigger", "1").parquet(path)
    delay = f"{now // 1_000_000 + 1} seconds"
    found = run_available(holes_in_order(stream, "1 second", 5, 10, delay), "holes").where("sender_port <> 99").collect()
    ordered = sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][2], r[0]))
    model = _scan_model([row for _, row in ordered], 1_000_000, 5, 10)
    expected = sorted((m[0], m[1], m[2], m[4], m[5]) for m in model if m[5] and m[2] == "arrival")
    ends = sorted((m[0], m[4], m[5]) for m in model if m[5] and m[2] == "lease_end")
    got = [(r.sender_port, r.msg_id, r.kind, r.epoch, r.holes) for r in found]
    assert sorted(g for g in got if g[2] == "arrival") == expected and expected
    assert sorted((g[0], g[3], g[4]) for g in got if g[2] == "lease_end") == ends and ends
