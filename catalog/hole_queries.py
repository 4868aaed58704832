"""Missing ids per sender, on ids numbered from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import DOCS, IDS, query
from wirelog.operators.decode import valid_fragments
from wirelog.operators.defrag import defragment
from wirelog.operators.encode import packetize
from wirelog.operators.holes import (
    gaps_at_expiry,
    gaps_exact,
    gaps_online,
    id_epochs,
    loss_report,
    new_message_ids,
    sender_leases,
    top_ids,
)
from wirelog.plans.decode_capture import decode_capture

#: A sender that is silent for so long starts anew; the events of a user come hours apart.
IDLE = "12 hours"

GAPS_SQL = """, steps AS (
  SELECT sender_port, msg_id AS after_id,
         lead(msg_id) OVER (PARTITION BY sender_port ORDER BY msg_id) AS before_id FROM {0}
)
SELECT sender_port, after_id, before_id, before_id - after_id - 1 AS hole_size FROM steps
WHERE before_id - after_id - 1 BETWEEN 1 AND 10"""


def _gaps(gaps):
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("after_id", "before_id", "hole_size")]
    return gaps.select("sender_port", *numbers)


@query("gaps_exact", IDS + GAPS_SQL.format("ids"))
def exact(spark, sf_dir):
    return _gaps(gaps_exact(X.event_ids(spark, sf_dir)))


@query("gaps_bucketed", IDS + GAPS_SQL.format("jumping"))
def bucketed(spark, sf_dir):
    """Small buckets, so that many holes lie across two of them."""
    return _gaps(gaps_exact(X.event_ids(spark, sf_dir, resets=True), bucket=8))


# The tracker, one arrival of every lease of every sender per step: bounds of the epoch and the
# largest ids. A jump forgets; after a jump down the id counts as the maximum.
TRACK_SQL = """, marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOURS THEN 1 ELSE 0 END AS starts
  FROM jumping WINDOW w AS (PARTITION BY sender_port ORDER BY ts, event_id)
), leased AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY sender_port ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS lease FROM marked
), queue AS (
  SELECT sender_port, lease, msg_id,
         row_number() OVER (PARTITION BY sender_port, lease ORDER BY ts, event_id) AS pos
  FROM leased
), track AS (
  SELECT sender_port, lease, pos, msg_id, msg_id AS lo, msg_id AS hi, [msg_id] AS recent,
         0 AS epoch, CAST(0 AS BIGINT) AS hole FROM queue WHERE pos = 1
  UNION ALL
  SELECT q.sender_port, q.lease, q.pos, q.msg_id,
    CASE WHEN s.down OR s.up THEN NULL ELSE least(coalesce(s.lo, q.msg_id), q.msg_id) END,
    CASE WHEN s.up THEN NULL WHEN s.down THEN q.msg_id
         ELSE greatest(coalesce(s.hi, q.msg_id), q.msg_id) END,
    CASE WHEN s.down OR s.up THEN [q.msg_id]
         WHEN list_contains(s.recent, q.msg_id) THEN s.recent
         WHEN len(s.recent) < {0} THEN list_sort(list_append(s.recent, q.msg_id))
         ELSE list_sort(list_append(s.recent, q.msg_id))[2:] END,
    CASE WHEN s.down OR s.up THEN s.epoch + 1 ELSE s.epoch END,
    CASE WHEN s.down OR s.up OR list_contains(s.recent, q.msg_id) OR len(s.recent) < {0} THEN 0
         ELSE CASE WHEN list_sort(list_append(s.recent, q.msg_id))[2]
                        - list_sort(list_append(s.recent, q.msg_id))[1] - 1 BETWEEN 1 AND 10
              THEN list_sort(list_append(s.recent, q.msg_id))[2]
                   - list_sort(list_append(s.recent, q.msg_id))[1] - 1 ELSE 0 END END
  FROM (SELECT t.*, n.msg_id AS next_id,
               coalesce(t.lo - n.msg_id > 10, false) AS down,
               coalesce(n.msg_id - t.hi > 10, false) AS up
        FROM track t JOIN queue n
        ON n.sender_port = t.sender_port AND n.lease = t.lease AND n.pos = t.pos + 1) s
  JOIN queue q ON q.sender_port = s.sender_port AND q.lease = s.lease AND q.pos = s.pos + 1
)
"""


@query("id_epochs", IDS + TRACK_SQL.format(1) + "SELECT sender_port, msg_id, lease, epoch FROM track")
def epochs(spark, sf_dir):
    found = id_epochs(X.event_ids(spark, sf_dir, resets=True), idle=IDLE)
    return found.select("sender_port", "msg_id", "lease", "epoch")


@query(
    "gaps_online",
    IDS
    + TRACK_SQL.format(5)
    + "SELECT sender_port, msg_id, lease, epoch, hole AS holes FROM track WHERE hole > 0",
)
def online(spark, sf_dir):
    ids = X.event_ids(spark, sf_dir, resets=True)
    found = gaps_online(ids, idle=IDLE, ids_per_port=5)
    return found.select("sender_port", "msg_id", "lease", "epoch", F.col("holes").cast("bigint").alias("holes"))


@query(
    "gaps_at_expiry",
    IDS
    + TRACK_SQL.format(5)
    + """, ends AS (
  SELECT sender_port, lease, list_transform(range(1, len(recent)), lambda p: recent[p + 1] - recent[p] - 1)
         AS sizes FROM track QUALIFY pos = max(pos) OVER (PARTITION BY sender_port, lease)
)
SELECT sender_port, lease, CAST(list_sum(list_filter(sizes, lambda s: s BETWEEN 1 AND 10)) AS BIGINT) AS holes
FROM ends WHERE list_sum(list_filter(sizes, lambda s: s BETWEEN 1 AND 10)) > 0""",
)
def at_expiry(spark, sf_dir):
    ids = X.event_ids(spark, sf_dir, resets=True)
    found = gaps_at_expiry(ids, idle=IDLE, ids_per_port=5)
    return found.select("sender_port", "lease", F.col("holes").cast("bigint").alias("holes"))


@query(
    "capture_holes",
    IDS
    + TRACK_SQL.format(5)
    + """, ends AS (
  SELECT list_transform(range(1, len(recent)), lambda p: recent[p + 1] - recent[p] - 1) AS sizes
  FROM track QUALIFY pos = max(pos) OVER (PARTITION BY sender_port, lease)
)
SELECT 'udp' AS listener, CAST((SELECT sum(hole) FROM track) AS BIGINT) AS holes_from_new_message,
 CAST((SELECT sum(list_sum(list_filter(sizes, lambda s: s BETWEEN 1 AND 10))) FROM ends) AS BIGINT)
 AS holes_from_dead_port, CAST((SELECT count(*) FROM track) AS BIGINT) AS v0_multipart_messages,
 CAST(0 AS BIGINT) AS misses, CAST((SELECT count(*) FROM track) AS BIGINT) AS fragments""",
)
def holes_of_a_capture(spark, sf_dir):
    """The detector inside the decode job, as its statistics show it."""
    payload = F.encode(F.concat(F.lit("m"), F.col("msg_id").cast("string")), "UTF-8")
    messages = X.event_ids(spark, sf_dir, resets=True).withColumn("payload", payload)
    packets = packetize(messages, X.FRAGMENT)
    rows = decode_capture(packets, idle=IDLE, ids_per_port=5).statistics
    return rows.select(
        "listener",
        "holes_from_new_message",
        "holes_from_dead_port",
        "v0_multipart_messages",
        "defragmenter.misses",
        F.aggregate("v0_fragments", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("fragments"),
    )


@query(
    "sender_leases",
    IDS
    + """, marked AS (
  SELECT sender_port, ts, event_id, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOURS THEN 1 ELSE 0 END
         AS starts FROM ids WINDOW w AS (PARTITION BY sender_port ORDER BY ts, event_id)
), leased AS (
  SELECT *, sum(starts) OVER (PARTITION BY sender_port ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lease FROM marked
)
SELECT sender_port, CAST(lease AS BIGINT) AS lease, epoch_us(min(ts)) AS first_us,
 epoch_us(max(ts)) AS last_us, CAST(count(*) AS BIGINT) AS messages FROM leased GROUP BY ALL""",
)
def leases(spark, sf_dir):
    found = sender_leases(X.event_ids(spark, sf_dir), idle="6 hours")
    return found.select(
        "sender_port",
        F.col("lease").cast("bigint").alias("lease"),
        F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"),
        "messages",
    )


@query(
    "top_ids",
    IDS
    + """SELECT sender_port, msg_id, CAST(row_number() OVER (PARTITION BY sender_port
 ORDER BY msg_id DESC) AS INTEGER) AS rank FROM ids QUALIFY rank <= 10""",
)
def largest(spark, sf_dir):
    found = top_ids(X.event_ids(spark, sf_dir), 10)
    return found.select("sender_port", F.col("msg_id").cast("bigint").alias("msg_id"), "rank")


@query(
    "loss_report_nulls",
    """SELECT CAST(NULL AS VARCHAR) AS sender_host, CAST(user_id AS INTEGER) AS sender_port,
 CAST(count(*) - 1 AS BIGINT) AS holes, CAST(2 * (count(*) - 1) AS BIGINT) AS missing_ids,
 CAST(count(*) AS BIGINT) AS incomplete_messages, CAST(2 * count(*) AS BIGINT) AS missing_fragments
 FROM events GROUP BY user_id""",
)
def report_without_hosts(spark, sf_dir):
    """Every third id used, each by a message that lacks two of its fragments; no host known."""
    ids = X.event_ids(spark, sf_dir, every=True).withColumns(
        {"sender_host": F.lit(None).cast("string"), "msg_id": F.col("msg_id") * 3}
    )
    header = F.struct(F.lit(5).alias("fragment_count"))
    generations = ids.select(*ids.columns, header.alias("first_header"), F.lit(3).alias("received"))
    report = loss_report(gaps_exact(ids), generations)
    return report.drop("listener")


@query(
    "loss_report",
    DOCS
    + """, got AS (SELECT * FROM f WHERE (doc_id * 31 + i) % 97 <> 0),
 partial AS (
  SELECT 1024 + doc_id % 16 AS port, doc_id, any_value(n) - count(*) AS gone FROM got GROUP BY ALL
), seen AS (SELECT DISTINCT 1024 + doc_id % 16 AS port, doc_id // 16 AS id FROM got),
 step AS (SELECT port, lead(id) OVER (PARTITION BY port ORDER BY id) - id - 1 AS hole FROM seen),
 h AS (SELECT port, count(*) AS holes, sum(hole) AS missing_ids FROM step
       WHERE hole BETWEEN 1 AND 10 GROUP BY ALL),
 p AS (SELECT port, count(*) AS incomplete_messages, sum(gone) AS missing_fragments FROM partial
       WHERE gone > 0 GROUP BY ALL)
SELECT CAST(coalesce(h.port, p.port) AS INTEGER) AS sender_port,
 CAST(coalesce(holes, 0) AS BIGINT) AS holes, CAST(coalesce(missing_ids, 0) AS BIGINT) AS missing_ids,
 CAST(coalesce(incomplete_messages, 0) AS BIGINT) AS incomplete_messages,
 CAST(coalesce(missing_fragments, 0) AS BIGINT) AS missing_fragments
FROM h FULL JOIN p ON h.port = p.port""",
)
def report(spark, sf_dir):
    fragments = valid_fragments(X.lost(X.document_packets(spark, sf_dir)))
    generations = defragment(fragments.where(F.col("fragment_count") > 1)).generations
    gaps = gaps_exact(new_message_ids(fragments, generations))
    return loss_report(gaps, generations).drop("listener", "sender_host")
