"""Reassembly of fragment streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wirelog.operators.compat import NAMES, OUTCOME, outcome
from wirelog.operators.message_state import PartialMessage
from wirelog.schemas import DEFAULT_DISORDER, DEFAULT_EXPIRE, HEADER_FIELDS, SENDER
from wirelog.session import duration_us

# Neighbouring ids of a sender share one state row and one call of Python, whose fixed cost is that of
# some hundred fragments; more ids would only make the row larger that an arrival writes again.
IDS_PER_GROUP = 32

STATE = (
    "messages array<struct<msg_id int, count int, size int, hash int, length int, first_us bigint, "
    "last_us bigint, tags array<string>, done boolean, indices array<int>, payloads array<binary>>>"
)


def id_group() -> Column:
    return F.floor(F.col("msg_id") / IDS_PER_GROUP).cast("int").alias("id_group")


def _load(state: GroupState) -> dict[int, PartialMessage]:
    messages = {}
    for msg_id, *header, tags, done, indices, payloads in state.get[0] if state.exists else ():
        pieces = {int(i): bytes(p) for i, p in zip(indices, payloads)}
        tags = None if tags is None else list(tags)
        messages[int(msg_id)] = PartialMessage(*map(int, header), tags, bool(done), pieces)
    return messages


def _save(state: GroupState, messages: dict[int, PartialMessage], expire_us: int) -> None:
    if not messages:
        if state.exists:
            state.remove()
        return
    rows = [
        (
            msg_id,
            message.count,
            message.size,
            message.hash,
            message.length,
            message.first_us,
            message.last_us,
            message.tags,
            message.done,
            list(message.pieces),
            list(message.pieces.values()),
        )
        for msg_id, message in messages.items()
    ]
    state.update((rows,))
    deadline = min(_deadline_ms(message, expire_us) for message in messages.values())
    state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))


def _deadline_ms(message: PartialMessage, expire_us: int) -> int:
    return (message.last_us + expire_us) // 1000


def _step(expire_us: int, compat: bool):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sender = tuple(key[:3])
        messages, touched, found = _load(state), set(), []

        def drop(msg_id: int) -> None:
            message = messages.pop(msg_id)
            if not message.done:
                found.append(outcome(sender, msg_id, "incomplete", message.last_us, message))

        if not state.hasTimedOut:
            arrivals = pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable")
            for fragment in arrivals.itertuples(index=False):
                us, msg_id = int(fragment.us), int(fragment.msg_id)
                touched.add(msg_id)
                if msg_id in messages and us - messages[msg_id].last_us >= expire_us:
                    drop(msg_id)
                if msg_id not in messages:
                    messages[msg_id] = PartialMessage.opened_by(fragment)
                message = messages[msg_id]
                verdict = message.ingest(fragment)
                if verdict == "complete":
                    found.append(outcome(sender, msg_id, "message", us, message, whole=True))
                    message.pieces = {}
                    if compat:
                        del messages[msg_id]
                elif verdict != "stored":
                    index = int(fragment.fragment_index)
                    found.append(outcome(sender, msg_id, verdict, us, message, index))
        watermark = state.getCurrentWatermarkMs()
        for msg_id in [m for m in messages if m not in touched]:
            if _deadline_ms(messages[msg_id], expire_us) < watermark:
                drop(msg_id)
        _save(state, messages, expire_us)
        if found:
            yield pd.DataFrame(found, columns=NAMES, dtype=object)

    return run


def defragment_stream(
    fragments: DataFrame,
    expire: str = DEFAULT_EXPIRE,
    watermark_delay: str = DEFAULT_DISORDER,
    compat: bool = False,
) -> DataFrame:
    """Low latency: a message leaves with the fragment that completes it.

    One output table, by ``kind``: ``message``, ``incomplete`` (after ``expire`` without a
    touch), ``invalid``, ``late_duplicate``. After completion a small marker stays in state
    until the lease ends, so that repeats are recognised; ``compat`` drops it, and a repeat
    opens a new message. Arrival order is restored within a micro-batch only. Ids that follow
    each other share a state row, see ``IDS_PER_GROUP``.
    """
    key = [*SENDER, "id_group"]
    columns = [*SENDER, id_group(), *HEADER_FIELDS, "tags", "payload", "ts", "seq"]
    prepared = fragments.where(F.col("fragment_count") > 1).withWatermark("ts", watermark_delay)
    return (
        prepared.select(*columns, F.unix_micros("ts").alias("us"))
        .groupBy(*key)
        .applyInPandasWithState(
            _step(duration_us(expire), compat),
            OUTCOME,
            STATE,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def _run_start(rows: str, field: str) -> Column:
    """The elements of an array sorted by ``field`` that begin a run of equal values."""
    return F.filter(
        rows,
        lambda x, i: (i == 0) | (F.get(F.col(rows), i - 1)[field] != x[field]),
    )


def _run_end(rows: str, field: str) -> Column:
    return F.filter(
        rows,
        lambda x, i: (i == F.size(rows) - 1) | (F.get(F.col(rows), i + 1)[field] != x[field]),
    )


def _moment(x: Column) -> Column:
    return F.struct(x["ts"], x["seq"])


def defragment_session(
    fragments: DataFrame, expire: str = DEFAULT_EXPIRE, watermark_delay: str = DEFAULT_DISORDER
) -> DataFrame:
    """Built-ins only: one row per generation, when its session closes. A message of one
    fragment has no session to wait for and leaves at once, whatever sizes it declares.

    The rules are those of the batch operator, written as array functions over the
    fragments of the session. Each step is linear in their number but for the sorts.
    """
    key = [*SENDER, "msg_id"]
    entry = F.struct(
        "ts", "seq", "fragment_index", "fragment_count", "fragment_size", "total_length",
        "msg_hash", "tags", "payload",
    )
    marked = fragments.withWatermark("ts", watermark_delay)
    sessions = (
        marked.where(F.col("fragment_count") > 1)
        .groupBy(*key, F.session_window("ts", expire).alias("session"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_all"))
        .withColumn("_first", F.col("_all")[0])
    )
    first = F.col("_first")

    def is_valid(x: Column) -> Column:
        offset = x["fragment_size"].cast("bigint") * x["fragment_index"]
        is_last = x["fragment_index"] == x["fragment_count"] - 1
        expected = F.when(is_last, first["total_length"] - offset).otherwise(
            first["fragment_size"]
        )
        same = [x[c] == first[c] for c in ("fragment_size", "fragment_count", "msg_hash")]
        return same[0] & same[1] & same[2] & (F.octet_length(x["payload"]) == expected)

    def by_index(x: Column) -> Column:
        return F.struct(x["fragment_index"].alias("fragment_index"), x["ts"], x["seq"], x["tags"], x["payload"])

    def in_time(x: Column) -> Column:
        return F.col("_done").isNull() | (_moment(x) <= F.col("_done"))

    def hex_of(x: Column) -> Column:
        return F.hex(x["payload"])

    tagged = F.filter("_valid", lambda x: x["tags"].isNotNull() & in_time(x))
    complete = F.size("_firsts") == first["fragment_count"]
    several = (
        sessions.withColumn("_valid", F.filter("_all", is_valid))
        .withColumn("_sorted", F.array_sort(F.transform("_valid", by_index)))
        .withColumn("_firsts", _run_start("_sorted", "fragment_index"))
        .withColumn("_done", F.when(complete, F.array_max(F.transform("_firsts", _moment))))
        .withColumn("_used", F.filter("_sorted", in_time))
        .withColumn("_lasts", _run_end("_used", "fragment_index"))
        .withColumn("_indices", F.transform("_lasts", lambda x: x["fragment_index"]))
        .withColumn("_late", F.size(F.filter("_all", lambda x: ~in_time(x))))
        .select(
            *key,
            "session",
            first["fragment_count"].alias("fragment_count"),
            first["total_length"].alias("total_length"),
            first["msg_hash"].alias("msg_hash"),
            complete.alias("complete"),
            F.col("_late").alias("late_duplicates"),
            F.array_except(
                F.sequence(F.lit(0), first["fragment_count"] - 1), "_indices"
            ).alias("missing"),
            F.coalesce(
                F.try_element_at(F.transform(tagged, lambda x: x["tags"]), F.lit(-1)),
                F.array().cast("array<string>"),
            ).alias("tags"),
            F.when(
                complete, F.unhex(F.array_join(F.transform("_lasts", hex_of), ""))
            ).alias("payload"),
        )
    )
    return several.unionByName(_single_sessions(marked, key, duration_us(expire)))


def _single_sessions(fragments: DataFrame, key: list[str], expire_us: int) -> DataFrame:
    """Single-fragment messages in the layout of :func:`defragment_session`."""
    end = F.timestamp_micros(F.unix_micros("ts") + expire_us)
    return fragments.where(F.col("fragment_count") == 1).select(
        *key,
        F.struct(F.col("ts").alias("start"), end.alias("end")).alias("session"),
        "fragment_count",
        "total_length",
        "msg_hash",
        F.lit(True).alias("complete"),
        F.lit(0).alias("late_duplicates"),
        F.array().cast("array<int>").alias("missing"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "payload",
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
