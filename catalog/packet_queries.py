"""Classification, headers, commands, encoding and hashing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import DOCS, query
from wirelog.functions.binary import log2_bucket, slice_bytes, utf8_text
from wirelog.functions.hashing import java_string_hash, with_murmur3
from wirelog.operators.decode import (
    classify_packets,
    header_rejects,
    numeric_message_key,
    parse_commands,
    split_single_multi,
    valid_fragments,
)
from wirelog.operators.encode import (
    assign_message_ids,
    chunk,
    packetize_rejects,
    tags_fit,
    text_payload,
)

KIND_SQL = """CASE WHEN event_id % 8 <= 1 THEN 'simple' WHEN event_id % 8 = 2 THEN 'invalid_version'
 WHEN event_id % 8 = 3 THEN 'invalid_type' WHEN event_id % 8 <= 6 THEN 'command'
 ELSE 'fragment' END"""


@query(
    "classify_packets",
    f"""SELECT 'udp' || CAST(user_id % 3 AS VARCHAR) AS listener, {KIND_SQL} AS kind,
 CAST(count(*) AS BIGINT) AS packets FROM events GROUP BY ALL""",
)
def classify(spark, sf_dir):
    kinds = classify_packets(X.event_packets(spark, sf_dir))
    return kinds.groupBy("listener", "kind").agg(F.count(F.lit(1)).alias("packets"))


@query(
    "parse_commands",
    """SELECT event_id AS seq,
 CASE event_id % 8 WHEN 4 THEN 'PING' WHEN 5 THEN 'BURP' END AS command,
 CASE event_id % 8 WHEN 4 THEN CAST(event_id AS VARCHAR) WHEN 5 THEN '' END AS trail,
 event_id % 8 = 4 AS known
 FROM events WHERE event_id % 8 IN (4, 5, 6)""",
)
def commands(spark, sf_dir):
    found = parse_commands(X.event_packets(spark, sf_dir))
    return found.select("seq", "command", utf8_text("trail").alias("trail"), "known")


def _header_packets(spark, sf_dir):
    """Fragment datagrams with every kind of malformed header, by ``event_id % 6``."""
    case = F.col("event_id") % 6
    body = F.encode("event_type", "UTF-8")

    def header(count, index, length, tags):
        fields = [(count, 2), (index, 2), (100, 2), (7, 4), (length, 4), (9, 4), (tags, 2)]
        digits = "".join(f"{value:0{2 * width}x}" for value, width in fields)
        return F.concat(F.unhex(F.lit("0001" + digits + "0000")), body)

    data = (
        F.when(case == 0, slice_bytes(header(1, 0, 5, 0), 0, 23))
        .when(case == 1, header(0, 0, 5, 0))
        .when(case == 2, header(2, 2, 5, 0))
        .when(case == 3, header(2, 1, 0xFFFFFFFF, 0))
        .when(case == 4, header(2, 1, 5, 300))
        .otherwise(header(2, 1, 5, 3))
    )
    return X.event_rows(spark, sf_dir).select(
        F.lit("udp").alias("listener"),
        "ts",
        F.col("event_id").alias("seq"),
        F.lit("192.0.2.2").alias("sender_host"),
        (F.col("user_id") + 1024).cast("int").alias("sender_port"),
        data.alias("data"),
    )


@query(
    "header_rejects",
    """SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'short_header'
 WHEN 1 THEN 'zero_count' WHEN 2 THEN 'index_out_of_range' WHEN 3 THEN 'negative_length'
 ELSE 'tags_overrun' END AS reason FROM events WHERE event_id % 6 <> 5""",
)
def rejects(spark, sf_dir):
    return header_rejects(_header_packets(spark, sf_dir)).select("seq", "reason")


@query(
    "header_accepts",
    """SELECT event_id AS seq, 2 AS fragment_count, 1 AS fragment_index,
 substr(event_type, 1, 3) AS tag, substr(event_type, 4) AS body
 FROM events WHERE event_id % 6 = 5""",
)
def accepts(spark, sf_dir):
    return valid_fragments(_header_packets(spark, sf_dir)).select(
        "seq",
        "fragment_count",
        "fragment_index",
        F.array_join("tags", ",").alias("tag"),
        utf8_text("payload").alias("body"),
    )


@query(
    "packetize",
    DOCS
    + """SELECT doc_id, CAST(i AS INTEGER) AS fragment_index,
 '0001' || lpad(hex(n), 4, '0') || lpad(hex(i), 4, '0') || '0100'
   || lpad(hex(doc_id // 16), 8, '0') || lpad(hex(len), 8, '0') AS header,
 least(256, len - 256 * i) + 24 AS packet_length,
 md5(substr(hx, CAST(i * 512 + 1 AS BIGINT), 512)) AS body_md5 FROM f""",
)
def split(spark, sf_dir):
    packets = X.document_packets(spark, sf_dir)
    size = F.octet_length("data")
    return packets.select(
        "doc_id",
        "fragment_index",
        F.hex(slice_bytes("data", 0, 16)).alias("header"),
        size.cast("bigint").alias("packet_length"),
        F.md5(F.hex(slice_bytes("data", 24, size - 24)).cast("binary")).alias("body_md5"),
    )


@query(
    "packetize_rejects",
    """SELECT doc_id, CASE WHEN octet_length(encode(lang || source)) + 16 > 64 THEN 'tags_too_large'
  WHEN (octet_length(encode(text)) - 1) % 64 + 1 + octet_length(encode(lang || source)) + 16 > 64
  THEN 'tags_spill' END AS reason
 FROM documents
 WHERE (octet_length(encode(text)) - 1) % 64 + 1 + octet_length(encode(lang || source)) + 16 > 64
 AND octet_length(encode(text)) % 64 <> 0""",
)
def split_refused(spark, sf_dir):
    # Prefixes and the separator take 16 bytes besides lang and source.
    tags = F.array(F.concat(F.lit("language:"), "_lang"), F.concat(F.lit("where:"), "_source"))
    docs = X.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("_lang"), F.col("source").alias("_source")
    )
    messages = X.document_messages(spark, sf_dir).withColumn("seq", X.doc_id())
    tagged = messages.join(docs, "seq").withColumn("tags", tags)
    return packetize_rejects(tagged, 88).select(F.col("seq").alias("doc_id"), "reason")


@query(
    "tags_fit",
    """SELECT doc_id, octet_length(encode(lang || source)) + 7 <= 12 AS fits FROM documents""",
)
def fit(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    tags = F.array(F.concat(F.lit("kt:"), "source"), F.concat(F.lit("pk:"), "lang"))
    return docs.select("doc_id", tags_fit(tags, 36).alias("fits"))


@query(
    "parse_fragments",
    DOCS
    + """SELECT doc_id, 1024 + doc_id % 16 AS sender_port, doc_id // 16 AS msg_id,
 n AS fragment_count, i AS fragment_index, 256 AS fragment_size, len AS total_length,
 least(256, len - 256 * i) AS payload_length,
 (1024 + doc_id % 16) * 4294967296 + doc_id // 16 AS message_key, n = 1 AS single FROM f""",
)
def parse(spark, sf_dir):
    fragments = valid_fragments(X.document_packets(spark, sf_dir))
    single, multi = split_single_multi(fragments)
    both = single.withColumn("single", F.lit(True)).unionByName(
        multi.withColumn("single", F.lit(False))
    )
    numbers = ["sender_port", "msg_id", "fragment_count", "fragment_index", "total_length"]
    numbers += ["payload_length"]
    return both.select(
        X.doc_id().alias("doc_id"),
        *[F.col(c).cast("bigint").alias(c) for c in numbers],
        "fragment_size",
        numeric_message_key().alias("message_key"),
        "single",
    )


MURMUR_SQL = """
WITH b AS (
  SELECT doc_id, hex(encode(text)) AS hx, CAST(octet_length(encode(text)) AS BIGINT) AS len
  FROM documents
), words AS (
  SELECT doc_id, len, hx, list_transform(range(0, len // 4), lambda w:
    CAST('0x' || substr(hx, w * 8 + 7, 2) || substr(hx, w * 8 + 5, 2)
         || substr(hx, w * 8 + 3, 2) || substr(hx, w * 8 + 1, 2) AS HUGEINT)) AS ws,
    substr(hx, (len // 4) * 8 + 1) AS rest
  FROM b
), body AS (
  SELECT doc_id, len, rest, list_reduce(list_transform(ws, lambda w:
      (((((w * 3432918353) % 4294967296) * 32768) % 4294967296)
       + ((w * 3432918353) % 4294967296) // 131072) * 461845907 % 4294967296), lambda h, k:
      ((((xor(h, k) * 8192) % 4294967296) + xor(h, k) // 524288) * 5 + 3864292196) % 4294967296,
      CAST(0 AS HUGEINT)) AS h
  FROM words
), tail AS (
  SELECT doc_id, len, h, CASE WHEN rest = '' THEN CAST(0 AS HUGEINT) ELSE
    CAST('0x' || substr(rest, 5, 2) || substr(rest, 3, 2) || substr(rest, 1, 2) AS HUGEINT) END
    * 3432918353 % 4294967296 AS k
  FROM body
), mixed AS (
  SELECT doc_id, xor(xor(h, ((k * 32768) % 4294967296 + k // 131072) * 461845907 % 4294967296),
                     CAST(len AS HUGEINT)) AS h
  FROM tail
), f1 AS (SELECT doc_id, xor(h, h // 65536) * 2246822507 % 4294967296 AS h FROM mixed),
f2 AS (SELECT doc_id, xor(h, h // 8192) * 3266489909 % 4294967296 AS h FROM f1),
f3 AS (SELECT doc_id, xor(h, h // 65536) AS h FROM f2)
SELECT doc_id, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS BIGINT) AS hash
FROM f3
"""


@query("murmur3", MURMUR_SQL)
def murmur(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select(
        "doc_id", F.encode("text", "UTF-8").alias("payload")
    )
    hashed = with_murmur3(docs, "payload", "hash")
    return hashed.select("doc_id", F.col("hash").cast("bigint").alias("hash"))


JAVA_HASH = """list_reduce(list_transform(range(1, length({0}) + 1), lambda p:
 CAST(unicode(substr({0}, p, 1)) AS HUGEINT)),
 lambda h, u: (h * 31 + u) % 4294967296, CAST(0 AS HUGEINT))"""


@query(
    "java_string_hash",
    f"""WITH k AS (SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS key FROM events),
 h AS (SELECT event_id, {JAVA_HASH.format("key")} AS h FROM k)
 SELECT event_id, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS BIGINT) AS hash
 FROM h""",
)
def java_hash(spark, sf_dir):
    key = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))
    return X.event_rows(spark, sf_dir).select(
        "event_id", java_string_hash(key).cast("bigint").alias("hash")
    )


@query(
    "log2_bucket",
    """SELECT l_orderkey, l_linenumber, l_partkey % 65536 AS number,
 CASE WHEN l_partkey % 65536 = 0 THEN 0 ELSE length(bin(l_partkey % 65536)) END AS bucket
 FROM lineitem""",
)
def buckets(spark, sf_dir):
    number = F.col("l_partkey") % 65536
    return X.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        number.alias("number"),
        log2_bucket(number).cast("bigint").alias("bucket"),
    )


@query(
    "assign_message_ids",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS msg_id
 FROM events""",
)
def number(spark, sf_dir):
    messages = X.event_rows(spark, sf_dir).select(
        F.lit("udp").alias("listener"),
        F.lit("192.0.2.2").alias("sender_host"),
        (F.col("user_id") % 7).cast("int").alias("sender_port"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    return assign_message_ids(messages).select(
        F.col("seq").alias("event_id"), F.col("msg_id").cast("bigint").alias("msg_id")
    )


@query(
    "latin1_chunks",
    """WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g') AS s FROM documents),
 s AS (SELECT doc_id, s, length(s) AS len, unnest(range(0, (length(s) + 999) // 1000)) AS i FROM t)
 SELECT doc_id, i AS fragment_index, (len + 999) // 1000 AS fragment_count, len AS total_length,
 md5(substr(s, CAST(i * 1000 + 1 AS BIGINT), 1000)) AS body_md5 FROM s""",
)
def latin1(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    messages = X.document_messages(spark, sf_dir).withColumn("doc_id", X.doc_id()).drop("payload")
    client = text_payload(messages.join(docs, "doc_id"), "text")
    fragments = valid_fragments(chunk(client, 1000))
    numbers = ["fragment_index", "fragment_count", "total_length"]
    return fragments.select(
        X.doc_id().alias("doc_id"),
        *[F.col(c).cast("bigint").alias(c) for c in numbers],
        F.md5(F.decode("payload", "ISO-8859-1").cast("binary")).alias("body_md5"),
    )
