"""Counters, histograms, profiles and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.message_queries import ROUTED_SQL, _routable_events
from catalog.registry import DOCS, query
from wirelog.operators.decode import valid_fragments
from wirelog.operators.defrag import defragment, reassemble
from wirelog.operators.routing import route
from wirelog.operators.stats import (
    checksum_histogram,
    counters,
    dropped_histogram,
    fragment_index_histogram,
    handler_stats,
    invalid_histogram,
    size_profile,
    stats_json,
    triangle,
)
from wirelog.plans.decode_capture import decode_capture
from wirelog.session import scratch_path
from wirelog.streaming.stats import rates

COUNTERS_SQL = """SELECT 'udp' || CAST(user_id % 3 AS VARCHAR) AS listener,
 CAST(count(*) FILTER (WHERE event_id % 8 <= 1) AS BIGINT) AS udp_simple_messages,
 CAST(count(*) FILTER (WHERE event_id % 8 = 2) AS BIGINT) AS udp_invalid_version,
 CAST(count(*) FILTER (WHERE event_id % 8 = 3) AS BIGINT) AS v0_invalid_type,
 CAST(count(*) FILTER (WHERE event_id % 8 = 7) AS BIGINT) AS v0_invalid_multipart_header,
 CAST(count(*) FILTER (WHERE event_id % 8 IN (5, 6)) AS BIGINT) AS unknown_command,
 CAST(count(*) FILTER (WHERE event_id % 8 = 4) AS BIGINT) AS v0_commands,
 CAST(0 AS BIGINT) AS exceptions, CAST(0 AS BIGINT) AS v0_multipart_fragments
 FROM events GROUP BY ALL"""


@query("counters", COUNTERS_SQL)
def counted(spark, sf_dir):
    return counters(X.event_packets(spark, sf_dir))


BITS = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


@query(
    "fragment_index_histogram",
    DOCS
    + f""", b AS (SELECT {BITS.format("i")} AS slot, count(*) AS k FROM f GROUP BY ALL)
 SELECT 'udp' AS listener, CAST(s.slot AS INTEGER) AS slot, CAST(coalesce(k, 0) AS BIGINT) AS fragments
 FROM range(0, 17) AS s(slot) LEFT JOIN b ON b.slot = s.slot""",
)
def index_histogram(spark, sf_dir):
    dense = fragment_index_histogram(valid_fragments(X.document_packets(spark, sf_dir)))
    return dense.select("listener", F.posexplode("histogram").alias("slot", "fragments"))


@query(
    "checksum_histogram",
    DOCS
    + f""", b AS (SELECT {BITS.format("(n - 1)")} AS slot, count(*) AS k FROM c WHERE doc_id % 53 = 0
  GROUP BY ALL)
 SELECT 'udp' AS listener, CAST(s.slot AS INTEGER) AS slot, CAST(coalesce(k, 0) AS BIGINT) AS messages
 FROM range(0, 17) AS s(slot) LEFT JOIN b ON b.slot = s.slot""",
)
def bad_checksums(spark, sf_dir):
    fragments = valid_fragments(X.corrupted(X.document_packets(spark, sf_dir)))
    dense = checksum_histogram(reassemble(fragments))
    return dense.select("listener", F.posexplode("histogram").alias("slot", "messages"))


LOST_SQL = f""", got AS (SELECT DISTINCT doc_id FROM f WHERE (doc_id * 31 + i) % 97 <> 0),
 cells AS (
  SELECT {BITS.format("(n - 1)")} AS count_log2, {BITS.format("i")} AS index_log2,
         CAST(count(*) AS BIGINT) AS fragments FROM f
  WHERE (doc_id * 31 + i) % 97 = 0 AND doc_id IN (SELECT doc_id FROM got) GROUP BY ALL
)"""


@query(
    "loss_histogram_2d",
    DOCS
    + LOST_SQL
    + """SELECT 'udp' AS listener, CAST(count_log2 AS INTEGER) AS count_log2,
 CAST(index_log2 AS INTEGER) AS index_log2, fragments FROM cells""",
)
def dropped(spark, sf_dir):
    fragments = valid_fragments(X.lost(X.document_packets(spark, sf_dir)))
    return dropped_histogram(defragment(fragments).generations)


@query(
    "loss_triangle",
    DOCS
    + LOST_SQL
    + """SELECT CAST(r.x AS INTEGER) AS count_log2, CAST(k.x AS INTEGER) AS index_log2,
 coalesce(fragments, 0) AS fragments
 FROM range(0, 17) AS r(x) JOIN range(0, 17) AS k(x) ON k.x <= r.x
 LEFT JOIN cells ON count_log2 = r.x AND index_log2 = k.x""",
)
def rendered(spark, sf_dir):
    fragments = valid_fragments(X.lost(X.document_packets(spark, sf_dir)))
    shown = triangle(dropped_histogram(defragment(fragments).generations))
    rows = shown.select(F.posexplode("histogram").alias("count_log2", "line"))
    return rows.select("count_log2", F.posexplode("line").alias("index_log2", "fragments"))


@query(
    "invalid_histogram",
    DOCS
    + f"""SELECT 'udp' AS listener, CAST({BITS.format("(n - 1)")} AS INTEGER) AS count_log2,
 1 AS index_log2, CAST(count(*) AS BIGINT) AS fragments FROM f
 WHERE doc_id % 41 = 0 AND n > 2 AND i = 1 GROUP BY ALL""",
)
def invalid(spark, sf_dir):
    fragments = valid_fragments(X.shortened(X.document_packets(spark, sf_dir)))
    return invalid_histogram(defragment(fragments).invalid)


@query(
    "handler_stats",
    ROUTED_SQL
    + """SELECT topic, 'kafka' AS name, CAST(count(*) AS BIGINT) AS seen_messages,
 CAST(count(*) FILTER (WHERE topic <> 'null') AS BIGINT) AS sent_messages,
 CAST(coalesce(sum(octet_length(encode(props))) FILTER (WHERE topic <> 'null'), 0) AS BIGINT)
 AS sent_bytes FROM r GROUP BY ALL""",
)
def handlers(spark, sf_dir):
    return handler_stats(route(_routable_events(spark, sf_dir), "fallback"), "kafka")


@query(
    "size_profile",
    """WITH s AS (SELECT CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents)
 SELECT CAST(count(*) AS BIGINT) AS n, min(size) AS smallest, max(size) AS largest,
 CAST(sum(size) AS BIGINT) AS total, round(avg(size), 3) AS mean,
 round(stddev_pop(size), 3) AS deviation, round(quantile_cont(size, 0.5), 3) AS p50,
 round(quantile_cont(size, 0.75), 3) AS p75, round(quantile_cont(size, 0.95), 3) AS p95,
 round(quantile_cont(size, 0.99), 3) AS p99 FROM s""",
)
def sizes(spark, sf_dir):
    messages = X.document_messages(spark, sf_dir).select(F.octet_length("payload").alias("size"))
    profile = size_profile(messages, "size", exact=True)
    rounded = ["mean", "deviation", "p50", "p75", "p95", "p99"]
    return profile.select(
        "n", "smallest", "largest", "total", *[F.round(c, 3).alias(c) for c in rounded]
    )


RATES_SQL = """, m AS (
  SELECT topic, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS slot FROM r
), w AS (
  SELECT topic, span, slot - unnest(range(0, span)) AS start
  FROM m, (VALUES (1), (5), (15)) AS s(span)
)
SELECT topic, CASE span WHEN 1 THEN '1 minute' WHEN 5 THEN '5 minutes' ELSE '15 minutes' END AS span,
 CAST(start * 60000000 AS BIGINT) AS start_us, CAST(count(*) AS BIGINT) AS messages FROM w GROUP BY ALL"""


@query("rates", ROUTED_SQL + RATES_SQL)
def rate_rows(spark, sf_dir):
    found = rates(route(_routable_events(spark, sf_dir), "fallback"))
    return found.select("topic", "span", F.unix_micros("window_start").alias("start_us"), "messages")


#: Fragments that were lost or lost a byte, and what the four histograms are made of.
DAMAGED_SQL = f""", seen AS (
  SELECT *, (doc_id * 31 + i) % 97 = 0 AS lost, doc_id % 41 = 0 AND n > 2 AND i = 1 AS short FROM f
), whole AS (
  SELECT doc_id, any_value(n) AS n, bool_or(lost OR short) AS partial, count(*) FILTER (WHERE NOT lost) AS k
  FROM seen GROUP BY doc_id HAVING NOT bool_and(lost)
), cells AS (
  SELECT 'fragments' AS histogram, 0 AS r, {BITS.format("i")} AS s FROM seen WHERE NOT lost
  UNION ALL SELECT 'invalid', {BITS.format("(n - 1)")}, {BITS.format("i")} FROM seen WHERE short AND NOT lost
  UNION ALL SELECT 'checksum', 0, {BITS.format("(n - 1)")} FROM whole WHERE NOT partial AND doc_id % 53 = 0
  UNION ALL SELECT 'dropped', {BITS.format("(n - 1)")}, {BITS.format("i")} FROM seen SEMI JOIN whole USING (doc_id)
  WHERE lost OR short
)"""

_LINE = """(SELECT string_agg(coalesce(k, 0), ',' ORDER BY x) FROM range(0, 17) AS t(x)
  LEFT JOIN (SELECT s, count(*) AS k FROM cells WHERE histogram = '{0}' GROUP BY s) ON s = x)"""
_TRIANGLE = """(SELECT string_agg(line, ';' ORDER BY y) FROM (
  SELECT y, string_agg(coalesce(k, 0), ',' ORDER BY x) AS line
  FROM range(0, 17) AS a(y) JOIN range(0, 17) AS b(x) ON x <= y
  LEFT JOIN (SELECT r, s, count(*) AS k FROM cells WHERE histogram = '{0}' GROUP BY r, s) ON r = y AND s = x
  GROUP BY y))"""
_NO_LINE = "array_to_string(list_transform(range(0, 17), lambda x: 0), ',')"
_NO_TRIANGLE = """array_to_string(list_transform(range(1, 18),
  lambda y: array_to_string(list_transform(range(0, y), lambda x: 0), ',')), ';')"""


@query(
    "stats_json",
    DOCS
    + DAMAGED_SQL
    + f""", e AS ({COUNTERS_SQL})
 SELECT e.*, CAST(0 AS BIGINT) AS v0_multipart_messages, CAST(0 AS BIGINT) AS holes_from_new_message,
  CAST(0 AS BIGINT) AS holes_from_dead_port, CAST(0 AS BIGINT) AS unhandled_objects, CAST(0 AS BIGINT) AS evictions,
  CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS misses, {_NO_LINE} AS v0_fragments, {_NO_LINE} AS v0_invalid_checksum,
  {_NO_TRIANGLE} AS v0_invalid_fragments, {_NO_TRIANGLE} AS dropped_fragments, 0 AS handlers FROM e
 UNION ALL BY NAME
 SELECT 'udp' AS listener, CAST(0 AS BIGINT) AS udp_simple_messages, CAST(0 AS BIGINT) AS udp_invalid_version,
  CAST(0 AS BIGINT) AS v0_invalid_type, CAST(0 AS BIGINT) AS v0_invalid_multipart_header, CAST(0 AS BIGINT) AS unknown_command,
  CAST(0 AS BIGINT) AS v0_commands, CAST(0 AS BIGINT) AS exceptions,
  CAST((SELECT count(*) FROM seen WHERE NOT lost) AS BIGINT) AS v0_multipart_fragments,
  CAST((SELECT count(*) FROM whole WHERE NOT partial AND doc_id % 53 <> 0) AS BIGINT) AS v0_multipart_messages,
  CAST(0 AS BIGINT) AS holes_from_new_message, CAST(0 AS BIGINT) AS holes_from_dead_port, CAST(0 AS BIGINT) AS unhandled_objects,
  CAST((SELECT count(*) FROM whole WHERE n > 1 AND partial) AS BIGINT) AS evictions,
  CAST((SELECT sum(k) - count(*) FROM whole WHERE n > 1) AS BIGINT) AS hits,
  CAST((SELECT count(*) FROM whole WHERE n > 1) AS BIGINT) AS misses,
  {_LINE.format("fragments")} AS v0_fragments, {_LINE.format("checksum")} AS v0_invalid_checksum,
  {_TRIANGLE.format("invalid")} AS v0_invalid_fragments, {_TRIANGLE.format("dropped")} AS dropped_fragments, 0 AS handlers""",
)
def document(spark, sf_dir):
    """Every field of the document, on a capture with losses, short fragments, wrong checksums and all other packets."""
    damaged = X.corrupted(X.shortened(X.lost(X.document_packets(spark, sf_dir))))
    columns = ["listener", "ts", "seq", "sender_host", "sender_port", "data"]
    path = scratch_path(spark, "mixed")
    damaged.select(*columns).unionByName(X.event_packets(spark, sf_dir).select(*columns)).write.parquet(f"{path}/packets")
    packets = spark.read.parquet(f"{path}/packets")
    rows = decode_capture(packets, fragments_path=f"{path}/fragments", detect_holes=False).statistics
    scalars = [
        "udp_simple_messages", "udp_invalid_version", "v0_invalid_type", "v0_invalid_multipart_header", "unknown_command",
        "v0_commands", "exceptions", "v0_multipart_fragments", "v0_multipart_messages", "holes_from_new_message",
        "holes_from_dead_port", "unhandled_objects",
    ]
    lines, triangles = ["v0_fragments", "v0_invalid_checksum"], ["v0_invalid_fragments", "dropped_fragments"]
    shape = [f"{name} bigint" for name in scalars]
    shape += [f"{name} array<bigint>" for name in lines] + [f"{name} array<array<bigint>>" for name in triangles]
    shape += ["defragmenter struct<evictions: bigint, hits: bigint, misses: bigint>", "handlers array<struct<name: string>>"]
    parsed = stats_json(rows).select("listener", F.from_json("stats", ", ".join(shape)).alias("s"))

    def joined(numbers):
        return F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",")

    return parsed.select(
        "listener",
        *[F.col(f"s.{name}") for name in scalars],
        "s.defragmenter.*",
        *[joined(F.col(f"s.{name}")).alias(name) for name in lines],
        *[F.array_join(F.transform(f"s.{name}", joined), ";").alias(name) for name in triangles],
        F.size("s.handlers").alias("handlers"),
    )
