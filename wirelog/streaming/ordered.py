"""Streams whose rows are taken in event-time order, whatever micro-batch they come in.

Rows wait in the state, keyed by their moment, until the watermark has passed them; then a
timer hands them on in order. Nothing earlier can follow, so results are those of a batch.
Arrivals are written in chunks of at most 64 rows; a chunk that the watermark cuts goes
back without the rows taken. A piece of a message that is not whole then is one more entry,
never written again while others come. Needs the RocksDB state store (``state_store(spark)`` sets it).
"""

from __future__ import annotations

import sys
from collections import namedtuple
from collections.abc import Iterator, MutableMapping
from heapq import heappop, heappush
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from wirelog.operators.compat import NAMES, OUTCOME, outcome
from wirelog.operators.decode import message_key
from wirelog.operators.id_state import IdMemory, observe, remaining_holes
from wirelog.operators.message_state import PartialMessage
from wirelog.schemas import (
    DEFAULT_DISORDER,
    DEFAULT_EXPIRE,
    DEFAULT_IDLE,
    DEFAULT_IDS_PER_PORT,
    DEFAULT_MAX_HOLE,
    HEADER_FIELDS,
    SENDER,
)
from wirelog.session import duration_us
from wirelog.streaming.defrag import id_group
from wirelog.streaming.holes import NAMES as HOLE_NAMES
from wirelog.streaming.holes import OUTPUT as HOLE_OUTPUT

PLACE = "us bigint, seq bigint, nth bigint"
MOMENT = itemgetter(0, 1)
PORTS_PER_GROUP = 32
CHUNK_ROWS, CHUNK_BYTES = 64, 1 << 16
RUN_ROWS, RUN_BYTES = 1 << 13, 1 << 24  # sorted at once, in memory
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ceil_ms(us: int) -> int:
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them; ``take`` gets them in order.

    Every access to the state is a message to the JVM, so rows wait in chunks of neighbouring
    moments. Chunks are numbered as they arrive, which orders rows of one moment and keeps repeats.
    """

    def __init__(self, columns: str, output: list[str]):
        self.columns, self.output = columns, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.settled = handle, {}
        self.row = namedtuple("Waiting", ["us", "seq", *self.names])
        self.waiting = handle.getMapState("waiting", PLACE, f"rows array<struct<us bigint, seq bigint, {self.columns}>>")
        self.prepare(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark, run, first, pick = timerValues.getCurrentWatermarkInMs(), [], None, None
        self.settled.pop(tuple(key), None)
        number = 1 + max((place[2] for place in self.waiting.keys()), default=-1)
        size = 0
        for row in rows:
            pick = pick or itemgetter(*[row.__fields__.index(name) for name in self.row._fields])
            run.append(pick(tuple(row)))
            size += self.weight(run[-1])
            first = run[-1][0] if first is None else min(first, run[-1][0])
            if len(run) == RUN_ROWS or size >= RUN_BYTES:
                number, run, size = self._keep(run, number), [], 0
        if run:
            self._keep(run, number)
        if first is not None:
            self.handle.registerTimer(max(_ceil_ms(first), watermark + 1))
        yield from ()

    def _keep(self, run: list, number: int) -> int:
        """Store rows as chunks in the order of their moments; returns the next chunk's number."""
        chunk, size = [], 0
        for row in sorted(run, key=MOMENT):
            if len(chunk) == CHUNK_ROWS or size >= CHUNK_BYTES:
                self.waiting.updateValue((*chunk[0][:2], number), (chunk,))
                number, chunk, size = number + 1, [], 0
            chunk.append(row)
            size += self.weight(row)
        self.waiting.updateValue((*chunk[0][:2], number), (chunk,))
        return number + 1

    def _due(self, places: list, until_us: int, left: list) -> Iterator[tuple]:
        """Rows up to a moment from chunks in order, merged; what is later goes back, its moment to ``left``."""
        heap: list = []
        for place in places:
            while heap and heap[0][:2] < place[:2]:
                yield heappop(heap)[-1]
            rows = [tuple(row) for row in self.waiting.getValue(place)[0]]
            self.waiting.removeKey(place)
            passed = [row for row in rows if row[0] <= until_us]
            for nth, row in enumerate(passed):
                heappush(heap, (*row[:2], place[2], nth, row))
            rest = rows[len(passed) :]
            if rest:
                self.waiting.updateValue((*rest[0][:2], place[2]), (rest,))
                left.append(rest[0][0])
        while heap:
            yield heappop(heap)[-1]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.settled.get(tuple(key)) == watermark:  # another timer of the key has done it all
            return
        self.settled[tuple(key)] = watermark
        found: list = []
        waiting = sorted(tuple(place) for place in self.waiting.keys())
        due = [place for place in waiting if place[0] <= 1000 * watermark]
        left = [place[0] for place in waiting[len(due) :][:1]]
        self.resume(key, found)
        for row in self._due(due, 1000 * watermark, left):
            self.take(row[0], self.row(*row))
        wake = self.settle(1000 * watermark)
        later = [_ceil_ms(us) for us in left] + ([] if wake is None else [_ceil_ms(wake)])
        if later:
            self.handle.registerTimer(max(min(later), watermark + 1))
        yield from map(lambda row: Row(*self.output)(*row), found)

    def close(self) -> None:
        pass

    def weight(self, row: tuple) -> int:
        """Bytes of a row that are not its fixed columns."""
        return 0

    @property
    def names(self) -> list[str]:
        return [column.split()[0] for column in self.columns.split(", ")]


class StoredPieces(MutableMapping):
    """Payloads of one message by index. New ones stay in memory until ``store`` puts them into the map
    state; of those there only ``stored``, their number, is known without a look."""

    def __init__(self, state, msg_id: int, stored: int):
        self.state, self.msg_id, self.stored, self.held, self.new = state, msg_id, stored, stored, {}

    def __setitem__(self, index: int, payload: bytes) -> None:
        self.held += index not in self
        self.new[index] = payload

    def __getitem__(self, index: int) -> bytes:
        return self.new[index] if index in self.new else bytes(self.state.getValue((self.msg_id, index))[0])

    def __delitem__(self, index: int) -> None:
        self.held -= index in self
        self.new.pop(index, None)
        if self.stored and self.state.containsKey((self.msg_id, index)):
            self.state.removeKey((self.msg_id, index))
            self.stored -= 1

    def __contains__(self, index) -> bool:
        return index in self.new or (self.stored > 0 and self.state.containsKey((self.msg_id, index)))

    def __iter__(self):
        return iter({*self.new, *self._stored_indices()})

    def __len__(self) -> int:
        return self.held

    def _stored_indices(self) -> list[int]:
        return [key[1] for key in self.state.keys() if key[0] == self.msg_id] if self.stored else []

    def store(self) -> None:
        for index, payload in self.new.items():
            self.state.updateValue((self.msg_id, index), (payload,))
        self.stored, self.new = self.held, {}

    def forget(self) -> None:
        for index in self._stored_indices():
            self.state.removeKey((self.msg_id, index))
        self.stored, self.held, self.new = 0, 0, {}


class Reassembler(InOrder):
    """Fragments of neighbouring message ids: one row of small headers, and an entry per piece of a message
    that is not whole when the rows of a watermark have been taken."""

    HEADER = (
        "messages array<struct<msg_id int, count int, size int, hash int, length int, first_us bigint, "
        "last_us bigint, tags array<string>, done boolean, held int>>"
    )

    def __init__(self, expire_us: int):
        sender = "listener string, sender_host string, sender_port int, msg_id int"
        header = ", ".join(f"{name} int" for name in HEADER_FIELDS if name != "msg_id")
        super().__init__(f"{sender}, {header}, tags array<string>, payload binary", NAMES)
        self.expire_us = expire_us

    def prepare(self, handle) -> None:
        self.header = handle.getValueState("header", self.HEADER)
        self.pieces = handle.getMapState("pieces", "msg_id int, index int", "payload binary")

    def weight(self, row: tuple) -> int:
        return len(row[-1] or b"")

    def resume(self, key, found: list) -> None:
        self.key, self.found, self.senders, self.messages = key, found, {}, {}
        self.changed, self.kept = False, self.header.exists()
        for msg_id, *fields, tags, done, held in self.header.get()[0] if self.kept else ():
            tags = None if tags is None else list(tags)
            self.messages[msg_id] = PartialMessage(*fields, tags, done, StoredPieces(self.pieces, msg_id, held))

    def _end(self, msg_id: int) -> None:
        message, self.changed = self.messages.pop(msg_id), True
        if not message.done:
            pieces, message.pieces = message.pieces, dict.fromkeys(message.pieces)
            self.found.append(outcome(self._sender(msg_id), msg_id, "incomplete", message.last_us, message))
            pieces.forget()

    def _sender(self, msg_id: int) -> tuple:
        """Of the latest fragment; of the key, where nothing new came (a host that is not in the key is unknown)."""
        if msg_id in self.senders:
            return self.senders[msg_id]
        known = self.key.asDict() if hasattr(self.key, "asDict") else dict(zip(self.key_names, self.key))
        return tuple(known.get(name) for name in SENDER)

    def take(self, us: int, fragment) -> None:
        msg_id, self.changed = fragment.msg_id, True
        if msg_id in self.messages and us - self.messages[msg_id].last_us >= self.expire_us:
            self._end(msg_id)
        self.senders[msg_id] = sender = tuple(getattr(fragment, name) for name in SENDER)
        if msg_id not in self.messages:
            self.messages[msg_id] = PartialMessage.opened_by(fragment)
            self.messages[msg_id].pieces = StoredPieces(self.pieces, msg_id, 0)
        message = self.messages[msg_id]
        verdict = message.ingest(fragment)
        if verdict == "complete":
            self.found.append(outcome(sender, msg_id, "message", us, message, whole=True))
            message.pieces.forget()
        elif verdict != "stored":
            self.found.append(outcome(sender, msg_id, verdict, us, message, fragment.fragment_index))

    def settle(self, watermark_us: int) -> int | None:
        for msg_id in [m for m, message in self.messages.items() if watermark_us - message.last_us >= self.expire_us]:
            self._end(msg_id)
        if self.changed and self.messages:
            rows = []
            for msg_id, m in self.messages.items():
                m.pieces.store()
                rows.append((msg_id, m.count, m.size, m.hash, m.length, m.first_us, m.last_us, m.tags, m.done, len(m.pieces)))
            self.header.update((rows,))
        elif self.changed and self.kept:
            self.header.clear()
        return min((m.last_us + self.expire_us for m in self.messages.values()), default=None)


class IdWatcher(InOrder):
    """Ids of senders with neighbouring ports, and the memory of the online hole detector for each."""

    MEMORY = (
        "senders array<struct<sender_port int, lo bigint, hi bigint, recent array<bigint>, epoch int, last_us bigint>>"
    )

    def __init__(self, idle_us: int, capacity: int, max_hole: int):
        super().__init__("sender_port int, msg_id bigint", HOLE_NAMES)
        self.idle_us, self.capacity, self.max_hole = idle_us, capacity, max_hole

    def prepare(self, handle) -> None:
        self.stored = handle.getValueState("memory", self.MEMORY)

    def resume(self, key, found: list) -> None:
        self.host, self.found, self.memories, self.last_us = tuple(key)[:2], found, {}, {}
        self.changed, self.kept = False, self.stored.exists()
        for port, lo, hi, recent, epoch, last_us in self.stored.get()[0] if self.kept else ():
            self.memories[port], self.last_us[port] = IdMemory(lo, hi, list(recent), epoch), last_us

    def _end(self, port: int) -> None:
        memory, last_us, self.changed = self.memories.pop(port), self.last_us.pop(port), True
        holes = remaining_holes(memory, self.max_hole)
        if holes:
            self.found.append([*self.host, port, None, last_us, "lease_end", memory.epoch, holes])

    def take(self, us: int, row) -> None:
        port, self.changed = row.sender_port, True
        if port in self.memories and us - self.last_us[port] >= self.idle_us:
            self._end(port)
        memory = self.memories.setdefault(port, IdMemory())
        holes = observe(memory, row.msg_id, self.capacity, self.max_hole)
        self.last_us[port] = us
        if holes:
            self.found.append([*self.host, port, row.msg_id, us, "arrival", memory.epoch, holes])

    def settle(self, watermark_us: int) -> int | None:
        for port in [port for port, last_us in self.last_us.items() if watermark_us - last_us >= self.idle_us]:
            self._end(port)
        if self.changed and self.memories:
            rows = [(port, m.lo, m.hi, m.recent, m.epoch, self.last_us[port]) for port, m in self.memories.items()]
            self.stored.update((rows,))
        elif self.changed and self.kept:
            self.stored.clear()
        return min((last_us + self.idle_us for last_us in self.last_us.values()), default=None)


def _typed(names: list[str], ddl: str) -> StructType:
    schema = StructType.fromDDL(ddl)
    assert schema.names == names
    return schema


def defragment_in_order(
    fragments: DataFrame,
    expire: str = DEFAULT_EXPIRE,
    watermark_delay: str = DEFAULT_DISORDER,
    identity: str = "sender",
) -> DataFrame:
    """Reassembly that equals the batch operator for any disorder within ``watermark_delay``.

    The kinds are those of ``defragment_stream``; a row leaves when the watermark passes the
    fragment that causes it. ``identity`` as in ``message_key``: with ``port_only`` fragments of
    all hosts of a port meet, and an outcome names the host of its latest fragment, or none at expiry.
    """
    key = ["id_group", *[name for name in message_key(identity) if name != "msg_id"]]
    processor = Reassembler(duration_us(expire))
    processor.key_names = key
    several = fragments.where(F.col("fragment_count") > 1).withWatermark("ts", watermark_delay)
    rows = several.select(*processor.names, id_group(), F.unix_micros("ts").alias("us"), "seq", "ts")
    return rows.groupBy(*key).transformWithState(processor, _typed(NAMES, OUTCOME), "append", "eventTime")


def holes_in_order(
    ids: DataFrame,
    idle: str = DEFAULT_IDLE,
    ids_per_port: int = DEFAULT_IDS_PER_PORT,
    max_hole: int = DEFAULT_MAX_HOLE,
    watermark_delay: str = DEFAULT_DISORDER,
) -> DataFrame:
    """``holes_stream`` for arrivals that reach the stream in another order, within ``watermark_delay``."""
    if max_hole < 1 or ids_per_port < 1:
        raise ValueError("max_hole and ids_per_port must be positive")
    processor = IdWatcher(duration_us(idle), ids_per_port, max_hole)
    ports = F.floor(F.col("sender_port") / PORTS_PER_GROUP).cast("int").alias("port_group")
    rows = ids.withWatermark("ts", watermark_delay).select(
        *SENDER, ports, F.col("msg_id").cast("bigint").alias("msg_id"), "ts", "seq", F.unix_micros("ts").alias("us")
    )
    schema = _typed(HOLE_NAMES, HOLE_OUTPUT)
    return rows.groupBy("listener", "sender_host", "port_group").transformWithState(processor, schema, "append", "eventTime")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
