"""Replica of the online reassembly in which a repeat after completion opens a new message."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelog.operators.decode import message_key
from wirelog.operators.message_state import PartialMessage
from wirelog.schemas import ARRIVAL, DEFAULT_EXPIRE, HEADER_FIELDS, SENDER
from wirelog.session import duration_us

OUTCOME = (
    "listener string, sender_host string, sender_port int, msg_id int, kind string, us bigint, "
    "fragment_count int, fragment_index int, msg_hash int, tags array<string>, "
    "missing array<int>, payload binary"
)
NAMES = [column.split()[0] for column in OUTCOME.split(", ")]


def outcome(sender, msg_id, kind, us, message, index=None, whole=False) -> list:
    dropped = kind == "incomplete"
    return [
        *sender,
        int(msg_id),
        kind,
        us,
        message.count,
        index,
        message.hash,
        list(message.tags or []) if whole else None,
        message.missing() if dropped else None,
        message.payload() if whole else None,
    ]


def reassembler(expire_us: int, key: list[str]):
    """Streams through fragments sorted by key and arrival, holding one message at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, message, sender, msg_id = None, None, None, None
        for batch in batches:
            found = []
            for fragment in batch.itertuples(index=False):
                identity = tuple(getattr(fragment, name) for name in key)
                us = int(fragment.us)
                if message is not None and (
                    identity != current or us - message.last_us >= expire_us
                ):
                    found.append(outcome(sender, msg_id, "incomplete", message.last_us, message))
                    message = None
                current, msg_id = identity, fragment.msg_id
                sender = tuple(getattr(fragment, name) for name in SENDER)
                opened = message is None
                if opened:
                    message = PartialMessage.opened_by(fragment)
                verdict = message.ingest(fragment)
                if verdict == "invalid":
                    index = int(fragment.fragment_index)
                    found.append(outcome(sender, msg_id, verdict, us, message, index))
                elif verdict == "complete":
                    found.append(outcome(sender, msg_id, "message", us, message, whole=True))
                    message = None
            yield pd.DataFrame(found, columns=NAMES, dtype=object)
        if message is not None:
            last = outcome(sender, msg_id, "incomplete", message.last_us, message)
            yield pd.DataFrame([last], columns=NAMES, dtype=object)

    return run


def defragment_compat(
    fragments: DataFrame, expire: str = DEFAULT_EXPIRE, key: list[str] | None = None
) -> DataFrame:
    """Multi-fragment messages, drops and invalid fragments in one table, by ``kind``.

    Each partition is streamed in sorted order, so memory is bounded by one message.
    """
    key = key or message_key()
    columns = [*SENDER, *HEADER_FIELDS, "tags", "payload"]
    ordered = (
        fragments.where(F.col("fragment_count") > 1)
        .repartition(*key)
        .sortWithinPartitions(*key, *ARRIVAL)
        .select(*columns, F.unix_micros("ts").alias("us"))
    )
    return ordered.mapInPandas(reassembler(duration_us(expire), key), OUTCOME)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
