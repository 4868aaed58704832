"""Where messages and statistics go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wirelog.operators.messages import format_messages
from wirelog.operators.routing import drop_null_topic
from wirelog.session import scratch_path
from wirelog.sources.ledger import Ledger

Sink = Callable[[DataFrame], None]


def kafka_rows(routed: DataFrame) -> DataFrame:
    """The columns the Kafka writer understands; the discarding topic is left out."""
    columns = ["topic", F.col("key").cast("binary").alias("key"), "value"]
    if "partition" in routed.columns:
        columns.append("partition")
    return drop_null_topic(routed).select(*columns)


def write_kafka(routed: DataFrame, options: dict[str, str], checkpoint: str | None = None):
    """Publish to Kafka, batch or streaming; needs the connector on the class path."""
    rows = kafka_rows(routed)
    if routed.isStreaming:
        writer = rows.writeStream.format("kafka").options(**options)
        return writer.option("checkpointLocation", checkpoint).start()
    return rows.write.format("kafka").options(**options).save()


def write_topics(routed: DataFrame, path: str) -> None:
    """The same rows as Parquet, a directory per topic, where no broker is at hand."""
    kafka_rows(routed).write.partitionBy("topic").mode("append").parquet(path)


def write_text(messages: DataFrame, path: str) -> None:
    """One formatted line per message."""
    format_messages(messages).select("value").write.mode("append").text(path)


def write_events_by_type(events: DataFrame, path: str) -> None:
    """Accepted events, a directory per type."""
    flat = events.select(
        F.col("event.type").alias("type"),
        F.col("event.uuid").alias("uuid"),
        F.col("event.host").alias("host"),
        F.col("event.timestamp").alias("timestamp"),
        F.to_json("event.data").alias("data"),
    )
    flat.write.partitionBy("type").mode("append").parquet(path)


def count_sink(messages: DataFrame) -> int:
    """Swallow the messages and tell how many there were."""
    seen = Observation("count_sink")
    observed = messages.observe(seen, F.count(F.lit(1)).alias("n"))
    observed.write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def fan_out(
    messages: DataFrame,
    sinks: list[tuple[Sink, bool]],
    path: str | None = None,
    batch: int = 0,
    tolerant: bool = False,
) -> list[dict]:
    """Ordered chain of (sink, propagate): the first sink that does not propagate ends it.

    Where several sinks are reached the messages are computed once and written below ``path``, and
    each sink reads them there. A ledger beside them notes every sink that is through with
    ``batch``: called again with the same ``path`` and ``batch``, after whatever failure, the chain
    repeats no finished sink and computes nothing anew. The messages go when all are through.
    A sink that appends files by one Spark job thus has each message once.

    Returns what each sink saw, in the form that ``handlers_column`` shows: ``seen_messages``, and the
    ``logged_messages`` it took or the ``failed_messages`` it refused. A failing sink ends the chain
    with its error; a ``tolerant`` one goes on, and leaves the failed sink open in the ledger.
    """
    reached = []
    for sink, propagate in sinks:
        reached.append(sink)
        if not propagate:
            break
    spark = messages.sparkSession
    folder = f"{(path or scratch_path(spark, 'fan-out')).rstrip('/')}/{batch}"
    ledger = Ledger(spark, folder)
    if not ledger.has("messages/_SUCCESS") and not ledger.has("finished"):
        messages.write.mode("overwrite").parquet(f"{folder}/messages")
    if ledger.has("finished"):
        return []
    kept = spark.read.schema(messages.schema).parquet(f"{folder}/messages")
    seen, reports, failures = kept.count(), [], 0
    for place, sink in enumerate(reached):
        report = {"name": getattr(sink, "__name__", f"sink-{place}"), "seen_messages": seen}
        if not ledger.has(f"done-{place}"):
            try:
                sink(kept)
            except Exception:
                if not tolerant:
                    raise
                failures += 1
                reports.append({**report, "failed_messages": seen, "logged_messages": 0})
                continue
            ledger.note(f"done-{place}")
        reports.append({**report, "failed_messages": 0, "logged_messages": seen})
    if not failures:
        ledger.note("finished")
        ledger.drop("messages")
    return reports


def fan_out_stream(messages: DataFrame, sinks: list[tuple[Sink, bool]], checkpoint: str):
    """The same chain for a stream, per micro-batch; its ledger lies beside the checkpoint.

    Spark may run the last micro-batch again after a failure, never an earlier one, so the notes
    of a batch are dropped once a later one is through.
    """
    path = f"{checkpoint.rstrip('/')}-sinks"

    def write(batch: DataFrame, number: int) -> None:
        fan_out(batch, sinks, path, number)
        ledger = Ledger(batch.sparkSession, path)
        for name in ledger.names():
            if name.isdigit() and int(name) < number:
                ledger.drop(name)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
