import random

import pytest
from conftest import murmur3
from pyspark.sql import functions as F

from wirelog.functions.binary import latin1_bytes, log2_bucket, reverse_bytes, split_tags
from wirelog.functions.hashing import java_string_hash, key_group_partition, with_murmur3
from wirelog.session import duration_us


@pytest.mark.parametrize("seed", [0, 1, 10])
def test_murmur3_equals_plain_python(spark, seed):
    rnd = random.Random(seed)
    inputs = [bytes(rnd.randrange(256) for _ in range(n)) for n in range(66)]
    inputs += [b"\0" * 4, b"\xff" * 4, b"hello", b"abc", rnd.randbytes(5001)]
    df = spark.createDataFrame([(bytearray(x),) for x in inputs], "p binary")
    for row in with_murmur3(df, "p", "h", seed).collect():
        assert row.h == murmur3(bytes(row.p), seed)


def test_murmur3_golden(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),), (bytearray(b"abc"),)], "p binary")
    found = {bytes(r.p): r.h & 0xFFFFFFFF for r in with_murmur3(df, "p", "h").collect()}
    assert found == {b"hello": 0x248BFA47, b"abc": 0xB3DD93FA}


def test_hash_survives_filter_pushdown(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),)], "p binary")
    twice = with_murmur3(with_murmur3(df, "p", "a"), "p", "b")
    assert twice.where("a = b and a > 0").where("b % 2 = 1").count() == 1


def _java_hash(text):
    units = text.encode("utf-16-be")
    h = 0
    for at in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[at : at + 2], "big")) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def test_key_groups_equal_plain_python(spark):
    rnd = random.Random(7)
    keys = ["", "hello", "é\U0001f600x"] + [
        "".join(rnd.choice("abcXYZ+/09=") for _ in range(24)) for _ in range(300)
    ]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = df.select(
        "k",
        java_string_hash("k").alias("h"),
        key_group_partition("k", 1983, 10393).alias("p"),
        key_group_partition("k", 16).alias("q"),
    ).collect()
    for row in rows:
        code = _java_hash(row.k)
        mixed = murmur3((code & 0xFFFFFFFF).to_bytes(4, "little"))
        group = 0 if mixed == -(2**31) else abs(mixed)
        assert row.h == code
        assert row.p == group % 10393 * 1983 // 10393
        assert row.q == group % 16386 * 16 // 16386


def test_null_key_has_no_partition(spark):
    df = spark.createDataFrame([(None,)], "k string")
    assert df.select(key_group_partition("k", 8)).first()[0] is None


def test_tags(spark):
    cases = {b"foo\0": ["foo"], b"foo\0bar": ["foo", "bar"], b"": [], b"a\xff\0\0b": ["a�", "b"]}
    df = spark.createDataFrame([(bytearray(c),) for c in cases], "b binary")
    found = {bytes(r.b): r.t for r in df.select("b", split_tags("b").alias("t")).collect()}
    assert found == cases
    assert spark.range(1).select(split_tags(F.lit(None).cast("binary"))).first()[0] == []


def test_small_byte_functions(spark):
    row = spark.range(1).select(
        latin1_bytes(F.lit("aé€\U0001f600")).alias("l"),
        reverse_bytes(F.lit(bytearray(b"abc"))).alias("r"),
        F.array(*[log2_bucket(F.lit(n)) for n in (0, 1, 2, 3, 4, 7, 8, 65534, 65535)]).alias("b"),
    ).first()
    assert bytes(row.l) == b"a\xe9??" and bytes(row.r) == b"cba"
    assert row.b == [0, 1, 2, 2, 3, 3, 4, 16, 16]


def test_durations():
    assert duration_us("10 seconds") == 10_000_000 and duration_us("1 minute") == 60_000_000
    for bad in ("soon", "0 seconds"):
        with pytest.raises(ValueError):
            duration_us(bad)
