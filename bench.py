"""Headline timings: prints one JSON line.

Packets are cut from the documents once and stored; the timed jobs read them back as a
capture would be read, and write to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import fixtures as X  # noqa: E402
from catalog.message_queries import _routable_events  # noqa: E402
from catalog.stream_queries import PACKET_COLUMNS, with_closing_row  # noqa: E402
from wirelog.operators.decode import classify_packets, valid_fragments  # noqa: E402
from wirelog.operators.defrag import defragment, find_hot_keys, reassemble  # noqa: E402
from wirelog.operators.holes import gaps_exact, gaps_online, sender_leases  # noqa: E402
from wirelog.operators.routing import assign_partition, encrypt, route  # noqa: E402
from wirelog.operators.stats import counters  # noqa: E402
from wirelog.functions.hashing import murmur3_32  # noqa: E402
from wirelog.session import scratch_path  # noqa: E402
from wirelog.sources.readers import read_packets  # noqa: E402
from wirelog.streaming.defrag import defragment_session  # noqa: E402
from wirelog.streaming.run import run_available  # noqa: E402
from wirelog.streaming.stats import rates  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    packets_path, ids_path = scratch_path(spark, "packets"), scratch_path(spark, "ids")
    stream_path = scratch_path(spark, "stream")
    started = time.time()
    made = X.document_packets(spark, SF_DIR).select(*PACKET_COLUMNS)
    made.repartition(int(CPUS)).write.parquet(packets_path)
    prepared = time.time() - started
    X.event_ids(spark, SF_DIR).write.parquet(ids_path)
    packets = read_packets(spark, packets_path)
    with_closing_row(packets).write.parquet(stream_path)
    fragments = valid_fragments(packets)
    ids = spark.read.parquet(ids_path)
    events = _routable_events(spark, SF_DIR)
    messages = X.document_messages(spark, SF_DIR)

    def skewed():
        stuck = F.col("sender_port") % 3 == 0
        moved = fragments.withColumn("msg_id", F.when(stuck, -1).otherwise(F.col("msg_id")))
        moved = moved.withColumn("sender_port", F.when(stuck, 1).otherwise(F.col("sender_port")))
        hot = find_hot_keys(moved, min_rows=5000)
        return defragment(moved, "500 milliseconds", hot_keys=hot).messages

    jobs = {
        "packetize": lambda: consume(X.document_packets(spark, SF_DIR)),
        "decode": lambda: consume(fragments),
        "classify": lambda: consume(classify_packets(packets).groupBy("kind").count()),
        "murmur3": lambda: consume(messages.select(murmur3_32("payload"))),
        "defragment": lambda: consume(reassemble(fragments)),
        "defragment_skewed": lambda: consume(skewed()),
        "incomplete": lambda: consume(defragment(valid_fragments(
            packets.where(F.pmod(F.xxhash64("seq"), F.lit(97)) != 0))).incomplete),
        "gaps_exact": lambda: consume(gaps_exact(ids)),
        "gaps_online": lambda: consume(gaps_online(ids, idle="36500 days")),
        "sender_leases": lambda: consume(sender_leases(ids, "6 hours")),
        "counters": lambda: consume(counters(X.event_packets(spark, SF_DIR))),
        "route": lambda: consume(assign_partition(route(events, "fallback"), 1983, 10393)),
        "encrypt": lambda: consume(encrypt(events, "sixteen byte key")),
        "rates": lambda: consume(rates(route(events, "fallback"))),
        "defragment_session": lambda: consume(run_available(defragment_session(
            valid_fragments(read_packets(spark, stream_path, streaming=True))), "bench")),
    }
    chosen = sys.argv[1:] or list(jobs)
    seconds = {}
    for name in chosen:
        started = time.time()
        jobs[name]()
        seconds[name] = round(time.time() - started, 3)
    count = packets.count()
    size = packets.agg(F.sum(F.octet_length("data").cast("bigint"))).first()[0]
    rate = {n: round(count / seconds[n]) for n in ("decode", "defragment") if n in seconds}
    print(
        json.dumps(
            {
                "metric": "total seconds of headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "packets": count,
                "packet_bytes": size,
                "ids": ids.count(),
                "packets_per_second": rate,
                "prepare_seconds": round(prepared, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
