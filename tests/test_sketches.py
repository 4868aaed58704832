import random

from pyspark.sql import functions as F

from wirelog.operators.sketches import POINTS, RANK_ERROR, merge_sketches, profile_of, size_sketches


def test_merged_windows_equal_the_whole_within_the_error(spark):
    draw = random.Random(2)
    sizes = [(("a", "b")[n % 3 == 0], n * 1000, int(draw.lognormvariate(6, 2))) for n in range(30_000)] + [("c", 0, 7), (None, 5, 9), ("c", 1, None)]
    rows = spark.createDataFrame(sizes, "listener string, us bigint, size int").withColumn("ts", F.timestamp_micros("us"))
    parts = size_sketches(rows, F.col("size"), window="2 seconds")
    assert parts.count() > 25
    for merged in (merge_sketches(parts), merge_sketches(size_sketches(rows, F.col("size")))):
        found = {r.listener: r for r in profile_of(merged).collect()}
        assert set(found) == {"a", "b", "c", None} and found["c"].n == 1 and found["c"].p99 == 7
        for name in ("a", "b"):
            own, row = sorted(s for who, _, s in sizes if who == name), found[name]
            assert (row.n, row.smallest, row.largest, row.total) == (len(own), own[0], own[-1], sum(own))
            for p in POINTS:
                value = row[f"p{int(p * 100)}"]
                below, upto = (sum(test(s) for s in own) / len(own) for test in (lambda s: s < value, lambda s: s <= value))
                assert below - RANK_ERROR <= p <= upto + RANK_ERROR


def test_nothing(spark):
    rows = spark.createDataFrame([], "listener string, ts timestamp, size int")
    assert profile_of(merge_sketches(size_sketches(rows, F.col("size"), window="1 minute"))).collect() == []
