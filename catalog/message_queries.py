"""Messages, handlers, routing, encryption, lines and JSON events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.packet_queries import JAVA_HASH
from catalog.registry import query
from wirelog.functions.binary import latin1_bytes
from wirelog.operators.messages import (
    format_messages,
    parse_events,
    reverse_payload,
    split_events_by_type,
    truncate_payload,
)
from wirelog.operators.routing import (
    KEY_PREFIX,
    assign_partition,
    decrypt,
    drop_null_topic,
    encrypt,
    last_tag,
    route,
)
from wirelog.plans.decode_capture import decode_capture
from wirelog.plans.handlers import Reverse, Truncate, apply_handlers
from wirelog.session import scratch_path
from wirelog.sources.readers import (
    read_lines,
    read_listeners,
    read_packets,
    union_listeners,
)
from wirelog.sources.sinks import (
    count_sink,
    fan_out,
    write_events_by_type,
    write_text,
    write_topics,
)


def _tagged_documents(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    tags = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.array("source", "lang")
    )
    return docs.select("doc_id", tags.alias("tags"), F.encode("text", "UTF-8").alias("payload"))


def _routable_events(spark, sf_dir):
    """Tags by ``event_id % 6``: none; topic; key; both; two topics; the discarding topic."""
    case = F.col("event_id") % 6
    user = F.col("user_id").cast("string")
    topic = F.concat(F.lit("kt:"), "event_type")
    key = F.concat(F.lit("pk:"), "event_type", F.lit(":"), user)
    plain = F.lit("plain")
    tags = (
        F.when(case == 0, F.array(plain))
        .when(case == 1, F.array(topic, plain))
        .when(case == 2, F.array(key))
        .when(case == 3, F.array(key, topic))
        .when(case == 4, F.array(F.lit("kt:first"), key, topic))
        .otherwise(F.array(F.lit("kt:null"), key))
    )
    return X.event_rows(spark, sf_dir).select(
        "event_id", "ts", tags.alias("tags"), F.encode("props", "UTF-8").alias("payload")
    )


ROUTED_SQL = """
WITH r AS (
  SELECT event_id, ts, props, CASE event_id % 6 WHEN 0 THEN 'fallback' WHEN 2 THEN 'fallback'
    WHEN 5 THEN 'null' ELSE event_type END AS topic,
  CASE WHEN event_id % 6 >= 2 THEN event_type || ':' || CAST(user_id AS VARCHAR) END AS key
  FROM events
)
"""


@query(
    "format_messages",
    """SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text
 ELSE '[' || source || ',' || lang || '] ' || text END) AS digest FROM documents""",
)
def formatted(spark, sf_dir):
    lines = format_messages(_tagged_documents(spark, sf_dir))
    return lines.select("doc_id", F.md5(F.col("value").cast("binary")).alias("digest"))


@query(
    "truncate_payload",
    """SELECT doc_id, substr(hex(encode(text)), 1, 40) AS start FROM documents""",
)
def truncated(spark, sf_dir):
    messages = truncate_payload(_tagged_documents(spark, sf_dir), 20)
    return messages.select("doc_id", F.hex("payload").alias("start"))


REVERSED = """list_aggregate(list_reverse(list_transform(range(0, length(hx) // 2),
 lambda p: substr(hx, p * 2 + 1, 2))), 'string_agg', '')"""


@query(
    "reverse_payload",
    f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS hx FROM documents)
 SELECT doc_id, md5({REVERSED}) AS digest FROM h""",
)
def reversed_bytes(spark, sf_dir):
    messages = reverse_payload(_tagged_documents(spark, sf_dir))
    return messages.select("doc_id", F.md5(F.hex("payload").cast("binary")).alias("digest"))


@query(
    "apply_handlers",
    f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS hx FROM documents)
 SELECT doc_id, substr({REVERSED}, 1, 10) AS payload FROM h""",
)
def handled(spark, sf_dir):
    chain = apply_handlers(_tagged_documents(spark, sf_dir), [Reverse(), Truncate(5)])
    return chain.messages.select("doc_id", F.hex("payload").alias("payload"))


@query(
    "route",
    ROUTED_SQL + "SELECT epoch_us(ts) AS us, topic, key, md5(props) AS digest FROM r",
)
def routed(spark, sf_dir):
    rows = route(_routable_events(spark, sf_dir), "fallback")
    return rows.select(
        F.unix_micros("ts").alias("us"), "topic", "key", F.md5("value").alias("digest")
    )


@query(
    "null_topic",
    ROUTED_SQL
    + "SELECT topic, CAST(count(*) AS BIGINT) AS messages FROM r WHERE topic <> 'null' GROUP BY ALL",
)
def null_topic(spark, sf_dir):
    rows = drop_null_topic(route(_routable_events(spark, sf_dir), "fallback"))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"))


KEY_GROUP_SQL = f""", k AS (SELECT event_id, topic, key, {JAVA_HASH.format("key")} AS code FROM r),
 k1 AS (SELECT *, code * 3432918353 % 4294967296 AS x FROM k),
 k2 AS (SELECT *, ((x * 32768) % 4294967296 + x // 131072) * 461845907 % 4294967296 AS y FROM k1),
 k3 AS (SELECT *, xor((((y * 8192) % 4294967296 + y // 524288) * 5 + 3864292196) % 4294967296,
               CAST(4 AS HUGEINT)) AS h FROM k2),
 f1 AS (SELECT *, xor(h, h // 65536) * 2246822507 % 4294967296 AS h1 FROM k3),
 f2 AS (SELECT *, xor(h1, h1 // 8192) * 3266489909 % 4294967296 AS h2 FROM f1),
 f3 AS (SELECT *, xor(h2, h2 // 65536) AS h3 FROM f2),
 signed AS (SELECT *, CASE WHEN h3 > 2147483648 THEN 4294967296 - h3
                           WHEN h3 = 2147483648 THEN 0 ELSE h3 END AS positive FROM f3)
SELECT event_id, key, CAST((positive % 10393) * 1983 // 10393 AS INTEGER) AS partition FROM signed"""


@query("key_group_partition", ROUTED_SQL + KEY_GROUP_SQL)
def partitioned(spark, sf_dir):
    messages = _routable_events(spark, sf_dir)
    keyed = messages.withColumn("key", last_tag(KEY_PREFIX))
    return assign_partition(keyed, 1983, 10393).select("event_id", "key", "partition")


@query(
    "spread_null_keys",
    ROUTED_SQL
    + """SELECT key IS NULL AS keyless, CAST(count(*) AS BIGINT) AS messages, true AS in_range
 FROM r GROUP BY ALL""",
)
def spread(spark, sf_dir):
    rows = route(_routable_events(spark, sf_dir), "fallback")
    placed = assign_partition(rows, 12, spread=["ts", "value"])
    return placed.groupBy(F.col("key").isNull().alias("keyless")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.every(F.col("partition").between(0, 11)).alias("in_range"),
    )


def _encrypted(spark, sf_dir, mode):
    events = _routable_events(spark, sf_dir)
    sealed = encrypt(events, "sixteen byte key", mode)
    opened = decrypt(
        sealed.withColumn("sealed", F.col("payload")), "sixteen byte key", mode
    )
    return opened.select(
        "event_id",
        F.md5("payload").alias("digest"),
        F.octet_length("sealed").cast("bigint").alias("sealed_length"),
    )


@query(
    "encrypt_cbc",
    """SELECT event_id, md5(props) AS digest,
 16 + (octet_length(encode(props)) // 16 + 1) * 16 AS sealed_length FROM events""",
)
def encrypt_cbc(spark, sf_dir):
    return _encrypted(spark, sf_dir, "CBC")


@query(
    "encrypt_gcm",
    """SELECT event_id, md5(props) AS digest,
 CAST(28 + octet_length(encode(props)) AS BIGINT) AS sealed_length FROM events""",
)
def encrypt_gcm(spark, sf_dir):
    return _encrypted(spark, sf_dir, "GCM")


@query(
    "kafka_rows",
    ROUTED_SQL
    + """SELECT topic, CAST(count(*) AS BIGINT) AS messages, CAST(count(key) AS BIGINT) AS keys,
 CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM r WHERE topic <> 'null' GROUP BY ALL""",
)
def topics(spark, sf_dir):
    """Written by topic and read back."""
    path = scratch_path(spark, "topics")
    rows = route(_routable_events(spark, sf_dir), "fallback")
    write_topics(assign_partition(rows, 12), path)
    back = spark.read.parquet(path)
    return back.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count("key").alias("keys"),
        F.sum(F.octet_length("value").cast("bigint")).alias("bytes"),
    )


LINES_SQL = """WITH lines AS (
  SELECT unnest(string_split(text, chr(10))) AS line FROM documents
), bytes AS (
  SELECT list_transform(string_split(line, ''), lambda c: CASE WHEN ord(c) < 256 THEN ord(c) ELSE 63 END)
         AS codes FROM lines
)
SELECT len(codes) > 80 AS refused,
 md5(list_aggregate(list_transform(codes, lambda c: printf('%02X', c)), 'string_agg', '')) AS digest
FROM bytes WHERE len(codes) > 0 UNION ALL
SELECT false, md5('') FROM lines WHERE line = ''"""


def _framed_documents(spark, sf_dir, bounded):
    path = scratch_path(spark, "lines")
    docs = X.table(spark, sf_dir, "documents")
    returns = F.when(F.col("doc_id") % 5 == 0, F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r")))
    raw = latin1_bytes(F.coalesce(returns, F.col("text")))
    docs.select(raw.cast("string").alias("value")).write.text(path)
    messages, rejects = read_lines(spark, path, max_line=80, bounded=bounded)
    both = messages.select(F.lit(False).alias("refused"), "payload").unionByName(
        rejects.select(F.lit(True).alias("refused"), F.col("data").alias("payload"))
    )
    return both.select("refused", F.md5(F.hex("payload").cast("binary")).alias("digest"))


@query("lines", LINES_SQL)
def lines(spark, sf_dir):
    """The documents' lines in Latin-1, which is no UTF-8, every fifth with carriage returns."""
    return _framed_documents(spark, sf_dir, bounded=False)


@query("lines_bounded", LINES_SQL.replace("list_transform(codes,", "list_transform(codes[1:82],"))
def bounded_lines(spark, sf_dir):
    """The same by byte ranges; a refused line shows its first bytes."""
    return _framed_documents(spark, sf_dir, bounded=True)


@query(
    "write_text",
    """SELECT md5(unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN ''
 ELSE '[' || source || ',' || lang || '] ' END || text, chr(10)))) AS digest FROM documents""",
)
def text_sink(spark, sf_dir):
    """Whole texts, line breaks and all, as they stand in the files."""
    path = scratch_path(spark, "text")
    write_text(_tagged_documents(spark, sf_dir), path)
    return spark.read.text(path, lineSep="\n").select(F.md5(F.col("value").cast("binary")).alias("digest"))


@query("count_sink", "SELECT CAST(count(*) AS BIGINT) AS messages FROM documents")
def counted(spark, sf_dir):
    messages = _tagged_documents(spark, sf_dir)
    swallowed = count_sink(messages)
    return messages.agg(F.count(F.lit(1)).alias("messages")).where(F.col("messages") == swallowed)


@query(
    "fan_out",
    """SELECT 'first' AS sink, doc_id FROM documents UNION ALL
 SELECT 'second' AS sink, doc_id FROM documents""",
)
def fanned(spark, sf_dir):
    """Two sinks see every message; the second does not propagate, so a third sees none."""
    path = scratch_path(spark, "sinks")

    def sink(name):
        def write(messages):
            rows = messages.select(F.lit(name).alias("sink"), "doc_id")
            rows.write.mode("append").parquet(path)

        return write

    chain = [(sink("first"), True), (sink("second"), False), (sink("third"), True)]
    fan_out(_tagged_documents(spark, sf_dir), chain)
    return spark.read.parquet(path)


EVENT_JSON_SQL = """WITH e AS (
  SELECT event_id, user_id, event_type, props, event_id % 13 = 0 AS broken FROM events
)
"""


def _json_events(spark, sf_dir):
    event = F.to_json(
        F.struct(
            F.col("event_type").alias("type"),
            F.concat(F.lit("u-"), F.col("event_id").cast("string")).alias("uuid"),
            F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("host"),
            F.unix_millis("ts").alias("timestamp"),
            F.from_json("props", "k bigint").alias("data"),
        )
    )
    broken = F.col("event_id") % 13 == 0
    text = F.when(broken, F.concat(F.lit("{oops "), "event_type")).otherwise(event)
    return X.event_rows(spark, sf_dir).select(F.encode(text, "UTF-8").alias("payload"))


@query(
    "parse_events",
    """SELECT event_type AS type, 'u-' || CAST(event_id AS VARCHAR) AS uuid,
 'host' || CAST(user_id % 5 AS VARCHAR) AS host, epoch_us(ts) // 1000 AS timestamp,
 CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 13 <> 0""",
)
def parsed(spark, sf_dir):
    events = parse_events(_json_events(spark, sf_dir)).where(F.col("event").isNotNull())
    return events.select(
        "event.type",
        "event.uuid",
        "event.host",
        "event.timestamp",
        F.variant_get("event.data", "$.k", "bigint").alias("k"),
    )


@query(
    "events_by_type",
    EVENT_JSON_SQL
    + """SELECT CASE WHEN broken THEN 'not_an_event' WHEN event_type IN ('click', 'view')
 THEN event_type ELSE 'type_not_allowed' END AS outcome, CAST(count(*) AS BIGINT) AS events
 FROM e GROUP BY ALL""",
)
def by_type(spark, sf_dir):
    """Accepted events are written by type and read back; the rest keep their reason."""
    events = parse_events(_json_events(spark, sf_dir))
    accepted, refused = split_events_by_type(events, ["click", "view"])
    path = scratch_path(spark, "by-type")
    write_events_by_type(accepted, path)
    outcome = spark.read.parquet(path).select(F.col("type").alias("outcome")).unionByName(
        refused.select(F.col("reason").alias("outcome"))
    )
    return outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("events"))


@query(
    "all_messages",
    """WITH u AS (
  SELECT 'udp' || CAST(user_id % 3 AS VARCHAR) AS listener, 'simple' AS origin,
         octet_length(encode(event_type)) AS size FROM events WHERE event_id % 8 <= 1
  UNION ALL SELECT 'udp', 'fragments', octet_length(encode(text)) FROM documents
 )
 SELECT listener, origin, CAST(count(*) AS BIGINT) AS messages, CAST(sum(size) AS BIGINT) AS bytes
 FROM u GROUP BY ALL""",
)
def everything(spark, sf_dir):
    """A whole capture of several listeners, stored and decoded."""
    path = scratch_path(spark, "capture")
    columns = ["listener", "ts", "seq", "sender_host", "sender_port", "data"]
    capture = union_listeners(
        X.document_packets(spark, sf_dir).select(*columns),
        X.event_packets(spark, sf_dir).select(*columns),
    )
    capture.write.parquet(path)
    fragments_path = scratch_path(spark, "fragments")
    decoded = decode_capture(read_packets(spark, path), fragments_path=fragments_path)
    messages = decoded.messages
    origin = F.when(F.col("msg_id").isNull(), "simple").otherwise("fragments")
    return messages.groupBy("listener", origin.alias("origin")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.octet_length("payload").cast("bigint")).alias("bytes"),
    )


@query(
    "receive_size",
    "SELECT doc_id, 'small' AS listener, md5(substr(hex(encode(text)), 1, 200)) AS digest FROM documents",
)
def received(spark, sf_dir):
    """A listener with a small receive buffer cuts longer datagrams."""
    path = scratch_path(spark, "received")
    messages = X.document_messages(spark, sf_dir).withColumnRenamed("payload", "data")
    columns = ["listener", "ts", "seq", "sender_host", "sender_port", "data"]
    messages.select(*columns).write.parquet(path)
    packets = read_packets(spark, path, listener="small", receive_size=100)
    return packets.select(
        F.call_function("div", F.col("seq"), F.lit(65536)).alias("doc_id"),
        "listener",
        F.md5(F.hex("data").cast("binary")).alias("digest"),
    )


@query(
    "read_listeners",
    """SELECT k.name AS listener, doc_id, md5(substr(hex(encode(text)), 1, 2 * k.size)) AS digest
 FROM documents, (VALUES ('narrow', 50), ('usual', 300)) AS k(name, size)""",
)
def listeners(spark, sf_dir):
    """Two listeners on the same capture; one has a receive size of its own."""
    path = scratch_path(spark, "listeners")
    messages = X.document_messages(spark, sf_dir).withColumnRenamed("payload", "data")
    columns = ["listener", "ts", "seq", "sender_host", "sender_port", "data"]
    messages.select(*columns).write.parquet(path)
    settings = {"narrow": {"path": path, "receive_size": 50}, "usual": {"path": path}}
    packets = read_listeners(spark, settings, {"receive_size": 300})
    return packets.select(
        "listener",
        F.call_function("div", F.col("seq"), F.lit(65536)).alias("doc_id"),
        F.md5(F.hex("data").cast("binary")).alias("digest"),
    )
