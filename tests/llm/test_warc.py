import base64
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from wirelog.llm import warc

PAGES = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (9, "http://c", "same"), (3, None, None), (4, "u", ""),
    (5, "u", "é😀\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 300_000), (7, "u", "other"), (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
]


def expected(rows):
    payloads = {i: (html or "").encode() for i, _, html in rows}
    out = set()
    for i, payload in payloads.items():
        last = max(j for j, other in payloads.items() if other == payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.add((i, len(payload), digest, "response" if i == last else "revisit", None if i == last else last))
    return out


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_round_trip(spark, split):
    pages = spark.createDataFrame(ROWS, PAGES).withColumn("sha", F.lit("clash"))
    found = warc.archive_pages(pages, split_bytes=split).collect()
    assert len(found) == len(ROWS) and set(map(tuple, found)) == expected(ROWS)


def test_given_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    found = warc.archive_pages(pages, split_bytes=40_000).collect()
    assert len(found) == len(rows) and set(map(tuple, found)) == expected(rows)


def test_ties_null_ids_and_empty(spark):
    pages = spark.createDataFrame([(2, "u", "p"), (2, "u", "p"), (1, "u", "p"), (None, "u", "p"), (None, "u", "q")], PAGES)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect())
    assert kinds == sorted(
        [(0, "response", None), (0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)],
        key=lambda x: (x[0], x[1], x[2] or 0),
    )
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_small_payloads_are_all_responses(spark):
    found = warc.archive_pages(spark.createDataFrame(ROWS, PAGES), least_bytes=100).collect()
    assert {r.record_type for r in found} == {"response"}


def archive(payloads):
    return [warc.record_bytes("response", f"r{i}", "u", None, "D", p) for i, p in enumerate(payloads)]


def test_every_split_size_reads_each_record_once():
    draw = random.Random(3)
    payloads = [bytes(draw.randrange(256) for _ in range(draw.randrange(400))) for _ in range(12)]
    # incompressible payloads are stored as they are: magic bytes and a whole member inside one
    payloads[4] = b"\x1f\x8b\x08" * 20
    payloads[7] = bytes(draw.randrange(256) for _ in range(50)) + archive([bytes(draw.randrange(256) for _ in range(99))])[0] + b"tail"
    whole = b"".join(archive(payloads))
    for size in (1, 2, 3, 7, 50, 333, 5000):
        seen = []
        for start in range(0, len(whole), size):
            seen += warc.records_in(io.BytesIO(whole), len(whole), start, min(start + size, len(whole)))
        assert [(r["record_id"], r["payload"]) for r in seen] == [(f"r{i}", p) for i, p in enumerate(payloads)], size


def test_damage_costs_only_the_damaged_record():
    members = archive([b"one", b"two", b"three"])
    whole = b"junk" + members[0] + members[1][:20] + b"\0" * (len(members[1]) - 20) + members[2]
    seen = [r["payload"] for r in warc.records_in(io.BytesIO(whole), len(whole), 0, len(whole))]
    assert seen[-1] == b"three" and b"two" not in seen


def test_a_header_of_megabytes_is_read_back(spark):
    """A url of 3 MB that doesn't compress makes a header that no bound on headers may cut."""
    draw = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_%ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    url = "http://example.org/" + "".join(draw.choices(letters, k=3_000_000))
    rows = [(1, "http://a/", "one"), (2, url, "two"), (3, "http://b/", "three"), (4, url, "two")]
    found = warc.archive_pages(spark.createDataFrame(rows, PAGES), split_bytes=100_000).collect()
    assert len(found) == 4 and set(map(tuple, found)) == expected(rows)


def test_thousands_of_equal_pages(spark):
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "'same' AS html")
    found = warc.archive_pages(pages, split_bytes=1 << 16)
    assert found.count() == 20_000
    assert found.where("record_type = 'revisit' AND refers_to = 19999 AND payload_bytes = 4").count() == 19_999
