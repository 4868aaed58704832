"""Streams over stored packets, run to their end; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import fixtures as X
from catalog.hole_queries import IDLE, TRACK_SQL
from catalog.message_queries import ROUTED_SQL, _routable_events
from catalog.registry import DOCS, IDS, query
from catalog.stats_queries import COUNTERS_SQL, DAMAGED_SQL
from wirelog.operators.decode import valid_fragments
from wirelog.operators.defrag import with_checksum
from wirelog.operators.routing import route
from wirelog.operators.sketches import POINTS, RANK_ERROR, merge_sketches, profile_of, size_sketches
from wirelog.session import scratch_path
from wirelog.sources.readers import read_packets
from wirelog.streaming.decode import decode_stream
from wirelog.streaming.defrag import defragment_session, defragment_stream
from wirelog.streaming.holes import holes_stream
from wirelog.streaming.ordered import defragment_in_order, holes_in_order, state_store
from wirelog.streaming.run import run_available
from wirelog.streaming.stats import health, health_cells, rate, stats_stream, write_health

PACKET_COLUMNS = ["listener", "ts", "seq", "sender_host", "sender_port", "data"]


def stored(packets, name):
    path = scratch_path(packets.sparkSession, name)
    packets.write.parquet(path)
    return path


def with_closing_row(rows, day=86400000000):
    """One more row a day after the last: it moves the watermark past everything else."""
    example = rows.agg(F.max_by(F.struct(*rows.columns), F.struct("ts", "seq")).alias("_row"))
    moved = example.select("_row.*").withColumn("ts", X.shift(F.lit(day))).withColumn("listener", F.lit("closing"))
    return rows.unionByName(moved.select(*rows.columns))


def fragment_stream(spark, packets):
    path = stored(with_closing_row(packets.select(*PACKET_COLUMNS)), "packets")
    return valid_fragments(read_packets(spark, path, streaming=True))


REPEATED_SQL = (
    DOCS
    + """SELECT doc_id, NOT (n > 1 AND doc_id % 29 = 0 AND hx[1:2] <> '00') AS checksum_ok,
 CAST(n > 1 AND doc_id % 31 = 0 AS BIGINT) AS late_duplicates FROM c"""
)


@query("defragment_session", REPEATED_SQL)
def session(spark, sf_dir):
    fragments = fragment_stream(spark, X.repeated(X.document_packets(spark, sf_dir)))
    done = run_available(defragment_session(fragments), "sessions")
    checked = with_checksum(done.where("complete and listener <> 'closing'"))
    return checked.select(
        X.doc_id().alias("doc_id"),
        "checksum_ok",
        F.col("late_duplicates").cast("bigint").alias("late_duplicates"),
    )


@query(
    "session_singles",
    "SELECT doc_id, true AS complete, md5(text) AS digest, 0 AS missing FROM documents",
)
def sessions_of_singles(spark, sf_dir):
    """Messages of one fragment leave whole, though every second declares a wrong length."""
    packets = X.document_packets(spark, sf_dir)
    fragments = fragment_stream(spark, packets)
    wrong = (F.col("fragment_count") == 1) & (F.col("msg_id") % 2 == 0)
    declared = F.when(wrong, F.col("total_length") + 7).otherwise(F.col("total_length"))
    done = run_available(defragment_session(fragments.withColumn("total_length", declared)), "singles")
    return done.where("listener <> 'closing'").select(
        X.doc_id().alias("doc_id"), "complete", F.md5("payload").alias("digest"), F.size("missing").alias("missing")
    )


@query(
    "defragment_stream",
    DOCS
    + """, got AS (SELECT doc_id, any_value(n) AS n, count(*) AS k, any_value(text) AS text FROM f
  WHERE (doc_id * 31 + i) % 97 <> 0 GROUP BY doc_id)
 SELECT doc_id, CASE WHEN k = n THEN 'message' ELSE 'incomplete' END AS kind,
 CASE WHEN k = n THEN md5(text) END AS digest, n - k AS missing FROM got WHERE n > 1""",
)
def online(spark, sf_dir):
    fragments = fragment_stream(spark, X.lost(X.document_packets(spark, sf_dir)))
    found = run_available(defragment_stream(fragments), "messages")
    missing = F.when(F.col("missing").isNull(), 0).otherwise(F.size("missing"))
    return found.where("listener <> 'closing'").select(
        X.doc_id().alias("doc_id"),
        "kind",
        F.md5("payload").alias("digest"),
        missing.cast("bigint").alias("missing"),
    )


@query(
    "late_duplicates_stream",
    DOCS + "SELECT doc_id, 0 AS fragment_index FROM c WHERE n > 1 AND doc_id % 31 = 0",
)
def late(spark, sf_dir):
    fragments = fragment_stream(spark, X.repeated(X.document_packets(spark, sf_dir)))
    found = run_available(defragment_stream(fragments), "late")
    return found.where("kind = 'late_duplicate'").select(
        X.doc_id().alias("doc_id"), "fragment_index"
    )


def out_of_order(spark, rows, name, span_us):
    """Stored rows as micro-batches, read one after another: a row is in the batch of its time or the next one.

    The rows are computed once. A batch is written by as many tasks as the cluster runs at a time and read
    as so many files; should one be missing, a batch begins with a file of the next, which is no later than
    twice the span behind.
    """
    path, first = scratch_path(spark, name), rows.agg(F.min(F.unix_micros("ts"))).first()[0]
    turn = F.floor((F.unix_micros("ts") - F.lit(first)) / span_us) + F.pmod(F.hash("seq"), F.lit(2))
    placed, files = scratch_path(spark, f"{name}-placed"), spark.sparkContext.defaultParallelism
    rows.withColumn("_batch", turn.cast("int")).write.partitionBy("_batch").parquet(placed)
    schema = T.StructType([*rows.schema, T.StructField("_batch", T.IntegerType())])
    parts = spark.read.schema(schema).parquet(placed)
    for number in range(parts.agg(F.max("_batch")).first()[0] + 1):
        batch = parts.where(F.col("_batch") == number).drop("_batch").repartition(files)
        batch.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(files)).parquet(path)


@query(
    "stream_disorder",
    DOCS
    + """SELECT doc_id, 'message' AS kind, CAST(NULL AS INTEGER) AS fragment_index,
 CASE WHEN doc_id % 29 <> 0 THEN md5(text) END AS digest FROM c WHERE n > 1
 UNION ALL SELECT doc_id, 'late_duplicate', 0, NULL FROM c WHERE n > 1 AND doc_id % 31 = 0""",
)
def disorder(spark, sf_dir):
    """Fragments of one message come in two micro-batches, some repeats before the message is whole."""
    state_store(spark)
    packets = with_closing_row(X.repeated(X.document_packets(spark, sf_dir)).select(*PACKET_COLUMNS, "doc_id"))
    last = packets.where("listener <> 'closing'").agg(F.max("doc_id")).first()[0]
    span = (last // 5 + 1) * 1000000
    closing = F.col("listener") == "closing"
    end = F.lit(X.BASE_US + 9 * span)
    packets = packets.drop("doc_id").withColumn("ts", F.when(closing, F.timestamp_micros(end)).otherwise(F.col("ts")))
    stream = out_of_order(spark, packets, "disorder", span)
    found = run_available(defragment_in_order(valid_fragments(stream), "10 seconds", f"{2 * span} microseconds"), "ordered")
    whole = F.when(X.doc_id() % 29 != 0, F.md5("payload"))
    return found.where("listener <> 'closing'").select(
        X.doc_id().alias("doc_id"), "kind", "fragment_index", whole.alias("digest")
    )


HOLES_SQL = (
    IDS
    + TRACK_SQL.format(5)
    + """, ends AS (
  SELECT sender_port, list_transform(range(1, len(recent)), lambda p: recent[p + 1] - recent[p] - 1)
         AS sizes FROM track QUALIFY pos = max(pos) OVER (PARTITION BY sender_port, lease)
), left_over AS (
  SELECT sender_port, list_sum(list_filter(sizes, lambda s: s BETWEEN 1 AND 10)) AS holes FROM ends
)
SELECT sender_port, msg_id, 'arrival' AS kind, hole AS holes FROM track WHERE hole > 0
UNION ALL
SELECT sender_port, NULL, 'lease_end', CAST(holes AS BIGINT) FROM left_over WHERE holes > 0"""
)


def _found_holes(found):
    return found.where("listener <> 'closing'").select(
        "sender_port", F.col("msg_id").cast("bigint").alias("msg_id"), "kind", F.col("holes").cast("bigint").alias("holes")
    )


@query("holes_stream", HOLES_SQL)
def holes(spark, sf_dir):
    ids = X.event_ids(spark, sf_dir, resets=True)
    path = stored(with_closing_row(ids, day=86400000000 * 2), "ids")
    stream = spark.readStream.schema(ids.schema).parquet(path)
    return _found_holes(run_available(holes_stream(stream, idle=IDLE, ids_per_port=5), "holes"))


@query("holes_stream_disorder", HOLES_SQL)
def holes_of_disorder(spark, sf_dir):
    """Arrivals of ten days in one micro-batch or the next: their order is that of the events."""
    state_store(spark)
    span = 86400000000 * 10
    ids = with_closing_row(X.event_ids(spark, sf_dir, resets=True), day=span * 3)
    stream = out_of_order(spark, ids, "mixed-ids", span)
    found = holes_in_order(stream, IDLE, ids_per_port=5, watermark_delay="20 days")
    return _found_holes(run_available(found, "holes"))


@query(
    "decode_stream",
    """WITH u AS (
  SELECT 'udp' || CAST(user_id % 3 AS VARCHAR) AS listener, 'simple' AS origin,
         octet_length(encode(event_type)) AS size FROM events WHERE event_id % 8 <= 1
  UNION ALL
  SELECT 'udp', 'fragments', octet_length(encode(text)) FROM documents WHERE doc_id % 53 <> 0
 )
 SELECT listener, origin, CAST(count(*) AS BIGINT) AS messages, CAST(sum(size) AS BIGINT) AS bytes
 FROM u GROUP BY ALL""",
)
def decoded(spark, sf_dir):
    """Plain datagrams, whole documents and corrupted ones in one stream. The events cover
    a month, the documents minutes, so the disorder of this mixture is bounded by its span."""
    packets = X.corrupted(X.document_packets(spark, sf_dir)).select(*PACKET_COLUMNS)
    mixed = packets.unionByName(X.event_packets(spark, sf_dir).select(*PACKET_COLUMNS))
    path = stored(mixed, "mixed")
    messages = decode_stream(read_packets(spark, path, streaming=True), watermark_delay="400 days")
    found = run_available(messages, "decoded")
    origin = F.when(F.col("msg_id").isNull(), "simple").otherwise("fragments")
    return found.groupBy("listener", origin.alias("origin")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.octet_length("payload").cast("bigint")).alias("bytes"),
    )


@query("stats_stream", COUNTERS_SQL)
def running(spark, sf_dir):
    """Update mode: the last micro-batch to touch a listener holds its counters."""
    path = stored(X.event_packets(spark, sf_dir).repartition(4), "packets")
    stream = read_packets(spark, path, streaming=True, maxFilesPerTrigger="2")
    found = run_available(stats_stream(stream), "counters", "update")
    names = [c for c in found.columns if c not in ("listener", "batch")]
    latest = found.groupBy("listener").agg(F.max_by(F.struct(*names), "batch").alias("_last"))
    return latest.select("listener", "_last.*")


@query(
    "stats_stream_histograms",
    DOCS
    + DAMAGED_SQL
    + """SELECT 'udp' AS listener, histogram, CAST(r AS INTEGER) AS line, CAST(s AS INTEGER) AS slot,
 CAST(count(*) AS BIGINT) AS n FROM cells GROUP BY ALL""",
)
def running_histograms(spark, sf_dir):
    """The four histograms of the statistics document, added up micro-batch by micro-batch."""
    packets = X.corrupted(X.shortened(X.lost(X.document_packets(spark, sf_dir))))
    fragments = fragment_stream(spark, packets)
    path = scratch_path(spark, "health")
    query = write_health(health_cells(fragments, defragment_stream(fragments)), path, scratch_path(spark, "health-state"))
    query.trigger(availableNow=True).start().awaitTermination()
    rows = health(spark, path).where("listener <> 'closing'")
    flat = [
        rows.select("listener", F.lit(name).alias("histogram"), F.lit(0).alias("line"), F.posexplode(name).alias("slot", "n"))
        for name in ("fragments", "checksum")
    ]
    for name in ("invalid", "dropped"):
        lines = rows.select("listener", F.lit(name).alias("histogram"), F.posexplode(name).alias("line", "_cells"))
        flat.append(lines.select("listener", "histogram", "line", F.posexplode("_cells").alias("slot", "n")))
    union = flat[0]
    for part in flat[1:]:
        union = union.unionByName(part)
    return union.where("n > 0")


@query(
    "size_profile_stream",
    """SELECT 'udp' AS listener, CAST(count(*) AS BIGINT) AS n, CAST(min(size) AS BIGINT) AS smallest,
 CAST(max(size) AS BIGINT) AS largest, CAST(sum(size) AS BIGINT) AS total, true AS ranks_hold
 FROM (SELECT octet_length(encode(text)) AS size FROM documents)""",
)
def sizes_of_a_stream(spark, sf_dir):
    """Sketches of five-minute windows of a stream, merged; their quantiles are held against all sizes."""
    rows = X.document_messages(spark, sf_dir).select("listener", "ts", "seq", F.octet_length("payload").alias("size"))
    stream = spark.readStream.schema(rows.schema).parquet(stored(with_closing_row(rows), "sizes"))
    windows = run_available(size_sketches(stream, F.col("size"), window="5 minutes"), "sketches")
    profile = profile_of(merge_sketches(windows.where("listener <> 'closing'")))
    holds = F.lit(True)
    for p in POINTS:
        value = F.col(f"p{int(p * 100)}")
        below, upto = (F.avg(test.cast("double")) for test in (F.col("size") < value, F.col("size") <= value))
        holds = holds & (below <= p + RANK_ERROR) & (upto >= p - RANK_ERROR)
    exact = ["n", "smallest", "largest", "total"]
    return rows.join(profile, "listener").groupBy("listener", *exact).agg(holds.alias("ranks_hold"))


@query(
    "rates_stream",
    ROUTED_SQL
    + """, m AS (SELECT topic, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS slot FROM r),
 w AS (SELECT topic, slot - unnest(range(0, 15)) AS start FROM m)
 SELECT topic, CAST(start * 60000000 AS BIGINT) AS start_us, CAST(count(*) AS BIGINT) AS messages
 FROM w GROUP BY ALL""",
)
def rate_stream(spark, sf_dir):
    routed = route(_routable_events(spark, sf_dir), "fallback")
    closing = routed.agg(F.max("ts").alias("ts")).select(
        X.shift(F.lit(86400000000)).alias("ts"),
        F.lit("closing").alias("topic"),
        F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("binary").alias("value"),
    )
    path = stored(routed.unionByName(closing), "routed")
    stream = spark.readStream.schema(routed.schema).parquet(path)
    found = run_available(rate(stream, "15 minutes"), "rates")
    return found.where("topic <> 'closing'").select(
        "topic", F.unix_micros("window_start").alias("start_us"), "messages"
    )
