"""Reassembly and its losses, on packets cut from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import DOCS, query
from wirelog.operators.compat import defragment_compat
from wirelog.operators.decode import message_key, split_single_multi, valid_fragments
from wirelog.operators.defrag import (
    defrag_cache_stats,
    defragment,
    find_hot_keys,
    is_complete,
    missing_fragments,
    reassemble,
    verify_checksum,
    with_checksum,
)
from wirelog.session import scratch_path

LOST = "(doc_id * 31 + i) % 97 = 0"


def _digest(messages, *extra):
    return messages.select(
        X.doc_id().alias("doc_id"),
        F.octet_length("payload").cast("bigint").alias("length"),
        F.md5("payload").alias("digest"),
        *extra,
    )


@query(
    "defragment",
    "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, md5(text) AS digest, "
    "true AS checksum_ok FROM documents",
)
def whole(spark, sf_dir):
    fragments = valid_fragments(X.document_packets(spark, sf_dir))
    return _digest(reassemble(fragments), "checksum_ok")


@query(
    "defragment_lossy",
    DOCS
    + f"""SELECT doc_id, any_value(len) AS length, any_value(md5(text)) AS digest FROM f
 GROUP BY doc_id HAVING count(*) FILTER (WHERE {LOST}) = 0""",
)
def lossy(spark, sf_dir):
    fragments = valid_fragments(X.lost(X.document_packets(spark, sf_dir)))
    good, _ = verify_checksum(reassemble(fragments).drop("checksum_ok"))
    return _digest(good)


@query(
    "missing_fragments",
    DOCS
    + f"""SELECT doc_id, n AS fragment_count, i AS fragment_index FROM f WHERE {LOST}
 AND doc_id IN (SELECT doc_id FROM f WHERE NOT ({LOST}))""",
)
def missing(spark, sf_dir):
    fragments = valid_fragments(X.lost(X.document_packets(spark, sf_dir)))
    rows = missing_fragments(defragment(fragments).incomplete)
    return rows.select(
        X.doc_id().alias("doc_id"),
        F.col("fragment_count").cast("bigint").alias("fragment_count"),
        F.col("fragment_index").cast("bigint").alias("fragment_index"),
    )


@query(
    "checksum_failures",
    DOCS + "SELECT doc_id, n AS fragment_count FROM c WHERE doc_id % 53 = 0",
)
def failures(spark, sf_dir):
    fragments = valid_fragments(X.corrupted(X.document_packets(spark, sf_dir)))
    _, bad = verify_checksum(reassemble(fragments).drop("checksum_ok"))
    count = F.col("fragment_count").cast("bigint").alias("fragment_count")
    return bad.select(X.doc_id().alias("doc_id"), count)


@query(
    "invalid_fragments",
    DOCS
    + """SELECT doc_id, i AS fragment_index, 255 AS payload_length FROM f
 WHERE doc_id % 41 = 0 AND n > 2 AND i = 1""",
)
def invalid(spark, sf_dir):
    fragments = valid_fragments(X.shortened(X.document_packets(spark, sf_dir)))
    return defragment(fragments).invalid.select(
        X.doc_id().alias("doc_id"),
        F.col("fragment_index").cast("bigint").alias("fragment_index"),
        "payload_length",
    )


@query(
    "duplicate_fragments",
    DOCS
    + """SELECT doc_id, NOT (n > 1 AND doc_id % 29 = 0 AND hx[1:2] <> '00') AS checksum_ok,
 CASE WHEN n > 1 AND doc_id % 29 = 0 THEN md5('00' || hx[3:]) ELSE md5(hx) END AS digest,
 CAST(n > 1 AND doc_id % 31 = 0 AS BIGINT) AS late_duplicates FROM c""",
)
def duplicates(spark, sf_dir):
    fragments = valid_fragments(X.repeated(X.document_packets(spark, sf_dir)))
    result = defragment(fragments)
    late = result.generations.select(*message_key(), "generation", "late_duplicates")
    checked = with_checksum(result.messages).join(late, [*message_key(), "generation"])
    return checked.select(
        X.doc_id().alias("doc_id"),
        "checksum_ok",
        F.md5(F.hex("payload").cast("binary")).alias("digest"),
        "late_duplicates",
    )


@query(
    "late_duplicate_rows",
    DOCS
    + """SELECT doc_id, 0 AS fragment_index, least(256, len) AS payload_length FROM c
 WHERE n > 1 AND doc_id % 31 = 0""",
)
def late_rows(spark, sf_dir):
    fragments = valid_fragments(X.repeated(X.document_packets(spark, sf_dir)))
    return defragment(fragments).late_duplicates.select(
        X.doc_id().alias("doc_id"),
        "fragment_index",
        F.col("payload_length").cast("bigint").alias("payload_length"),
    )


DELAYED = """, a AS (
  SELECT doc_id, n, i, doc_id * 1000 + i + CASE WHEN doc_id % 37 = 0 AND n > 1 AND i = n - 1
         THEN 11000 ELSE 0 END AS ms FROM f
), flagged AS (
  SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY doc_id ORDER BY ms) >= 10000
            THEN 1 ELSE 0 END AS starts FROM a
), g AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY ms
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS generation FROM flagged
), gens AS (
  SELECT doc_id, CAST(generation AS INTEGER) AS generation, CAST(count(*) AS BIGINT) AS received,
         count(*) = any_value(n) AS complete FROM g GROUP BY ALL
)
"""


@query("generations", DOCS + DELAYED + "SELECT * FROM gens")
def generations(spark, sf_dir):
    fragments = valid_fragments(X.delayed(X.document_packets(spark, sf_dir)))
    return defragment(fragments).generations.select(
        X.doc_id().alias("doc_id"),
        "generation",
        F.col("received").cast("bigint").alias("received"),
        is_complete().alias("complete"),
    )


@query(
    "defrag_cache_stats",
    DOCS
    + DELAYED
    + """SELECT 'udp' AS listener, CAST(count(*) FILTER (WHERE NOT complete) AS BIGINT) AS evictions,
 CAST(sum(received) - count(*) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS misses FROM gens""",
)
def cache_stats(spark, sf_dir):
    fragments = valid_fragments(X.delayed(X.document_packets(spark, sf_dir)))
    return defrag_cache_stats(defragment(fragments).generations)


@query(
    "message_tags",
    """SELECT doc_id, CASE WHEN 255 - (octet_length(encode(text)) - 1) % 256
  >= octet_length(encode(source || lang)) + 7 THEN 'kt:' || source || ',pk:' || lang ELSE '' END
  AS tags, md5(text) AS digest FROM documents""",
)
def tags(spark, sf_dir):
    fragments = valid_fragments(X.document_packets(spark, sf_dir, tagged=True))
    return reassemble(fragments).select(
        X.doc_id().alias("doc_id"),
        F.array_join("tags", ",").alias("tags"),
        F.md5("payload").alias("digest"),
    )


@query(
    "arrival_disorder",
    "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, md5(text) AS digest "
    "FROM documents",
)
def disorder(spark, sf_dir):
    """The last fragment comes first."""
    packets = X.document_packets(spark, sf_dir)
    turned = F.col("fragment_count") - 1 - 2 * F.col("fragment_index")
    moved = packets.withColumn("ts", X.shift(turned * 1000)).withColumn("seq", F.col("seq") + turned)
    return _digest(reassemble(valid_fragments(moved)))


@query(
    "defragment_skewed",
    "SELECT CAST(1024 + doc_id % 16 * CAST(doc_id % 3 <> 0 AS INT) AS INTEGER) AS sender_port, "
    "CAST(octet_length(encode(text)) AS BIGINT) AS length, md5(text) AS digest FROM documents",
)
def skewed(spark, sf_dir):
    """A third of the documents come from one sender that never changes its message id, a
    second apart: one key with a third of all fragments, found and spread."""
    packets = X.document_packets(spark, sf_dir)
    stuck = F.col("doc_id") % 3 == 0
    fragments = (
        valid_fragments(packets)
        .withColumn("doc_id", X.doc_id())
        .withColumn("msg_id", F.when(stuck, -1).otherwise(F.col("msg_id")))
        .withColumn("sender_port", F.when(stuck, 1024).otherwise(F.col("sender_port")))
        .drop("doc_id")
    )
    hot = find_hot_keys(fragments, min_rows=500)
    result = defragment(fragments, expire="500 milliseconds", hot_keys=hot)
    return result.messages.select(
        "sender_port",
        F.octet_length("payload").cast("bigint").alias("length"),
        F.md5("payload").alias("digest"),
    )


PATHS_SQL = (
    DOCS
    + """, sent AS (
  SELECT doc_id, n, i, doc_id % 4 = 0 AS nameless,
         doc_id * 1000000 + i * 1000 AS us, doc_id * 65536 + i AS seq, false AS again FROM f WHERE n > 1
  UNION ALL
  SELECT doc_id, n, 0, doc_id % 4 = 0, doc_id * 1000000 + 500, doc_id * 65536, true FROM f
   WHERE n > 1 AND i = 0 AND doc_id % 29 = 0
  UNION ALL
  SELECT doc_id, n, 0, doc_id % 4 = 0, doc_id * 1000000 + 1000000, doc_id * 65536, true FROM f
   WHERE n > 1 AND i = 0 AND doc_id % 31 = 0
), kinds AS (
  SELECT *, CASE WHEN us = doc_id * 1000000 + 1000000 AND again THEN 'late_duplicate' END AS late FROM sent
)
SELECT doc_id, 'message' AS output, CAST(count(*) FILTER (WHERE late IS NULL) AS BIGINT) AS touches,
 min(us) AS first_us, arg_min(seq, us) AS first_seq FROM kinds GROUP BY doc_id
UNION ALL
SELECT doc_id, 'late_duplicate', 1, us, seq FROM kinds WHERE late IS NOT NULL
UNION ALL
SELECT doc_id, 'late_duplicate', 1, us, seq FROM kinds WHERE late IS NOT NULL AND doc_id % 2 = 0"""
)


def _both_paths(spark, sf_dir, min_rows):
    """Repeated fragments, the late ones of even documents twice at one instant, and every
    fourth document from a sender without a host."""
    packets = X.repeated(X.document_packets(spark, sf_dir)).withColumn(
        "sender_host", F.when(F.col("doc_id") % 4 != 0, F.col("sender_host"))
    )
    late = (F.unix_micros("ts") - X.BASE_US) == F.col("doc_id") * 1000000 + 1000000
    twice = packets.where(late & (F.col("doc_id") % 2 == 0) & (F.col("fragment_index") == 0) & (F.col("doc_id") % 31 == 0))
    _, parsed = split_single_multi(valid_fragments(packets.unionByName(twice)))
    # Parsed once: the search for crowded keys and each output read it again.
    path = scratch_path(spark, "fragments")
    parsed.write.parquet(path)
    fragments = spark.read.schema(parsed.schema).parquet(path)
    hot = None if min_rows is None else find_hot_keys(fragments, min_rows)
    result = defragment(fragments, hot_keys=hot, singles=False)
    messages = result.generations.where(is_complete()).select(
        X.doc_id().alias("doc_id"),
        F.lit("message").alias("output"),
        "touches",
        (F.unix_micros("first_ts") - X.BASE_US).alias("first_us"),
        "first_seq",
    )
    late_rows = result.late_duplicates.select(
        X.doc_id().alias("doc_id"),
        F.col("status").alias("output"),
        F.lit(1).cast("bigint").alias("touches"),
        (F.unix_micros("ts") - X.BASE_US).alias("first_us"),
        F.col("seq").alias("first_seq"),
    )
    return messages.unionByName(late_rows)


@query("defragment_paths", PATHS_SQL)
def usual_path(spark, sf_dir):
    return _both_paths(spark, sf_dir, None)


@query("defragment_paths_spread", PATHS_SQL)
def spread_path(spark, sf_dir):
    """The same rows with every key on the way of the crowded ones."""
    return _both_paths(spark, sf_dir, 0)


@query(
    "port_only_key",
    "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, md5(text) AS digest "
    "FROM documents",
)
def port_only(spark, sf_dir):
    """Fragments of one message leave two hosts; only the port-and-id key joins them."""
    fragments = valid_fragments(X.document_packets(spark, sf_dir))
    host = F.concat(F.lit("192.0.2."), (F.col("fragment_index") % 2 + 1).cast("string"))
    moved = fragments.withColumn("sender_host", host)
    return _digest(defragment(moved, key=message_key("port_only")).messages)


@query(
    "phantom_messages",
    DOCS
    + """SELECT doc_id, CASE WHEN kind = 1 THEN 'message' ELSE 'incomplete' END AS kind,
 CASE WHEN kind = 2 THEN n - 1 ELSE 0 END AS missing
 FROM c, (VALUES (1), (2)) AS k(kind)
 WHERE n > 1 AND (kind = 1 OR doc_id % 31 = 0)""",
)
def phantoms(spark, sf_dir):
    """With the online rule a late repeat opens a message that never completes."""
    fragments = valid_fragments(X.repeated(X.document_packets(spark, sf_dir)))
    outcomes = defragment_compat(fragments)
    return outcomes.select(
        X.doc_id().alias("doc_id"),
        "kind",
        F.when(F.col("missing").isNull(), 0).otherwise(F.size("missing")).cast("bigint").alias("missing"),
    )
