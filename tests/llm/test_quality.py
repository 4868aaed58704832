import math
from collections import Counter

import pytest
import xxhash
from helpers import docs_of, prose, words
from pyspark.sql import functions as F

from wirelog.llm import quality

SF = "/root/testdata/sf0.001"


def base(text):
    found = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = set()
    for i in range(len(found) - 7):
        if windows[tuple(found[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    failed = len(found) < 20 or 100 * len(covered) > 30 * len(found)
    return (
        len(found),
        sum(map(len, found)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


def signed(number):
    return number - 2**64 if number >= 2**63 else number


def hashes(text):
    """The hashes of words and pairs as Spark's xxhash64 has them."""
    single = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words(text)]
    raw = [n.to_bytes(8, "little") for n in single]
    pairs = [
        xxhash.xxh64_intdigest(b, seed=xxhash.xxh64_intdigest(a, seed=42)) for a, b in zip(raw, raw[1:])
    ]
    return [signed(n) for n in single + pairs]


def ratios(texts, trusted):
    raw = Counter(h % quality.BUCKETS for t in texts for h in hashes(t))
    good = Counter(h % quality.BUCKETS for t in trusted for h in hashes(t))
    share = sum(good.values()) / sum(raw.values())
    k = quality.SMOOTHING
    return lambda b: math.log((good[b] + k) / (share * raw[b] + k))


EDGES = [
    None, "", " \n\t ", "one", "a " * 30, "line here\nline here\n\nline here", " ".join(prose(1, 60)),
    " ".join(prose(2, 10) * 6) + " tail", "# $ % é | <b>" * 9, " lead trail ", "x" * 50_000,
    " ".join(prose(3, 40) + prose(4, 9) + prose(3, 40)), "\n".join(["same line of words"] * 400),
]


@pytest.mark.parametrize("whole", [True, False])
def test_counts_and_verdicts_equal_brute_force(spark, whole):
    if whole:
        docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    else:
        docs = docs_of(spark, EDGES)
        labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (7, 0, 0), (None, 1, 0), (11, None, None)], "doc_id bigint, quality int, toxic int")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    ratio = ratios(texts.values(), [texts[i] for i in good if i in texts])
    for row in quality.rate_quality(docs, labels, keep=["doc_id"]).collect():
        expected = base(texts[row.doc_id])
        assert tuple(row)[1:7] == expected, row
        every = [ratio(h % quality.BUCKETS) for h in hashes(texts[row.doc_id])]
        score = sum(every) / len(every) if every else 0.0
        assert row.llr == pytest.approx(score, abs=2e-6)
        assert row.kept == (not expected[-1] and row.llr >= quality.THRESHOLD)


def test_good_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rated = quality.rate_quality(docs, labels, keep=["doc_id"]).where("NOT base_failed").join(labels, "doc_id")
    shares = {r.quality: r.kept for r in rated.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] >= 0.995
    assert shares[0] <= 0.3


def test_clashing_columns_repeats_and_empty_tables(spark):
    text = " ".join(prose(5, 50))
    docs = docs_of(spark, [text, text]).union(docs_of(spark, [text])).withColumns(
        {"_w": F.lit(1), "llr": F.lit("old"), "a.b": F.lit(2), "_row": F.lit(3)}
    )
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rated = quality.rate_quality(docs, none)
    assert rated.count() == 3 and rated.where("kept AND llr = 0").count() == 3
    assert {"_w", "a.b", "_row", "llr"} <= set(rated.columns) and rated.columns.count("llr") == 1
    assert quality.rate_quality(docs.where("false"), none).count() == 0
