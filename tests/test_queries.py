import duckdb
import pytest

import __spark_entry__ as entry
from catalog import all_queries
from check_oracle import compare

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "classify_packets",
    "packetize",
    "murmur3",
    "defragment",
    "defragment_skewed",
    "duplicate_fragments",
    "gaps_online",
    "sender_leases",
    "loss_report",
    "key_group_partition",
    "stats_json",
    "lines",
    "lines_bounded",
    "id_epochs",
    "size_profile_stream",
    "stats_stream_histograms",
    "write_text",
    "session_singles",
    "loss_report_nulls",
    "defragment_paths_spread",
    "rates",
]


def test_every_query_has_its_sql():
    assert set(all_queries.QUERIES) == set(all_queries.ORACLES)
    assert set(all_queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "length", "digest", "checksum_ok"]
    assert rows.where("checksum_ok").count() == duckdb.sql(
        f"SELECT count(*) FROM '{SF}/documents.parquet'"
    ).fetchall()[0][0]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    verdict, _, fine = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert fine, verdict
