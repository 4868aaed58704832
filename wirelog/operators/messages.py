"""Operators on decoded messages, and the JSON events they may carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelog.functions.binary import reverse_bytes, slice_bytes, utf8_text
from wirelog.schemas import EVENT_JSON, MESSAGE_COLUMNS


def format_messages(messages: DataFrame) -> DataFrame:
    """``value``: ``[tag1,tag2] payload``, or the payload alone when there are no tags."""
    text = utf8_text("payload")
    prefix = F.concat(F.lit("["), F.array_join("tags", ","), F.lit("] "))
    tagged = F.coalesce(F.size("tags") > 0, F.lit(False))
    return messages.withColumn("value", F.when(tagged, F.concat(prefix, text)).otherwise(text))


def truncate_payload(messages: DataFrame, length: int) -> DataFrame:
    if length < 0:
        raise ValueError("length must not be negative")
    return messages.withColumn("payload", slice_bytes("payload", 0, length))


def reverse_payload(messages: DataFrame) -> DataFrame:
    return messages.withColumn("payload", reverse_bytes("payload"))


def as_messages(decoded: DataFrame, transport: str = "udp") -> DataFrame:
    """Decoded messages in the common layout."""
    return decoded.withColumn("transport", F.lit(transport)).select(*MESSAGE_COLUMNS)


def all_messages(*branches: DataFrame) -> DataFrame:
    """Simple, single-fragment and reassembled messages and lines as one table."""
    return reduce(
        DataFrame.unionByName, [branch.select(*MESSAGE_COLUMNS) for branch in branches]
    )


def parse_events(messages: DataFrame) -> DataFrame:
    """JSON events in ``event``; text that is none has a NULL ``event`` and keeps
    ``corrupt``."""
    text = utf8_text("payload")
    schema = f"{EVENT_JSON}, corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    parsed = messages.withColumn("_event", F.from_json(text, schema, options))
    bad = F.col("_event").isNull() | F.col("_event.corrupt").isNotNull()
    fields = [F.col(f"_event.{name}") for name in ("type", "uuid", "host", "timestamp", "data")]
    return (
        parsed.withColumn("corrupt", F.when(bad, text))
        .withColumn("event", F.when(~bad, F.struct(*fields)))
        .withColumn("event_time", F.timestamp_millis("event.timestamp"))
        .drop("_event")
    )


def split_events_by_type(events: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events of an accepted type, everything else with a ``reason``)."""
    accepted = F.coalesce(F.col("event.type").isin(allowed), F.lit(False))
    reason = F.when(F.col("event").isNull(), "not_an_event").otherwise("type_not_allowed")
    return events.where(accepted), events.where(~accepted).withColumn("reason", reason)
