"""A stream of datagrams to a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelog.operators.decode import simple_messages, split_single_multi, valid_fragments
from wirelog.operators.defrag import single_messages, with_checksum
from wirelog.operators.messages import all_messages, as_messages
from wirelog.schemas import DEFAULT_DISORDER, DEFAULT_EXPIRE
from wirelog.streaming.defrag import defragment_stream


def decode_stream(
    packets: DataFrame, expire: str = DEFAULT_EXPIRE, watermark_delay: str = DEFAULT_DISORDER
) -> DataFrame:
    """Every message as soon as it is whole. Unboxed datagrams and single fragments pass
    without state; only the others wait for each other."""
    single, several = split_single_multi(valid_fragments(packets))
    outcomes = defragment_stream(several, expire, watermark_delay)
    reassembled = outcomes.where("kind = 'message'").withColumn("ts", F.timestamp_micros("us"))
    columns = [c for c in reassembled.columns if c in single_messages(single).columns]
    whole = reassembled.select(*columns).unionByName(single_messages(single).select(*columns))
    good = with_checksum(whole).where("checksum_ok")
    return all_messages(simple_messages(packets), as_messages(good))
