"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Shared CTEs: d has one row per document, f one row per fragment of 256 bytes.
DOCS = """
WITH d AS (
  SELECT doc_id, text, lang, source, hex(encode(text)) AS hx,
         CAST(octet_length(encode(text)) AS BIGINT) AS len
  FROM documents
), c AS (
  SELECT *, (len + 255) // 256 AS n FROM d
), f AS (
  SELECT *, unnest(range(0, n)) AS i FROM c
)
"""

# Ids of the events: dense per user, every eleventh event lost; the second with a jump.
IDS = """
WITH RECURSIVE numbered AS (
  SELECT user_id, ts, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank
  FROM events
), ids AS (
  SELECT CAST(user_id AS INTEGER) AS sender_port, ts, event_id, CAST(rank AS BIGINT) AS msg_id
  FROM numbered WHERE event_id % 11 <> 0
), jumping AS (
  SELECT CAST(user_id AS INTEGER) AS sender_port, ts, event_id,
         CAST(rank + CASE WHEN rank > 40 THEN 1000 ELSE 0 END AS BIGINT) AS msg_id
  FROM numbered WHERE event_id % 11 <> 0
)
"""
