"""Quality rules: hashed n-gram log-likelihood ratio of trusted target and raw corpus.

Words and pairs of words are hashed into ``BUCKETS`` buckets. Two multinomials are counted over
all documents: the raw corpus and the documents that are trusted. A document's score is
the mean, over its words and pairs, of the log ratio of the two smoothed rates; the
length thus cancels, and every document at or above ``THRESHOLD`` is kept. No draw is made.

Only expressions of Spark's own are used. The multinomials are at most ``BUCKETS`` rows, so the
table of ratios is a literal array in the scoring pass, which has no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.llm.frames import NOT_SPACE, named, packed, settled, unpacked, words_of

BUCKETS = 1 << 14
#: Occurrences added to a bucket's count in the target and to the count expected from the raw
#: corpus, so that buckets seen a few times say little.
SMOOTHING = 20.0
THRESHOLD = -0.09
LEAST_WORDS = 20
WINDOW = 8
#: A trusted id set of at most so many distinct ids is sent to all tasks; beyond, it is joined.
BROADCAST_IDS = 500_000

OUTPUTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept",
]


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds hashes of words ``_w`` and of pairs ``_p`` to rows with ``_words``.

    Each step names a column that the next one reads more than once, so it is computed once.
    """
    hashed = rows.withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    pairs = F.transform("_w", lambda w, i: F.xxhash64(w, F.get(F.col("_w"), i + 1)))
    return hashed.withColumn("_p", F.slice(pairs, F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))))


def _counts(texts: DataFrame, name: str) -> DataFrame:
    rows = _hashed(texts.select(words_of(F.col("text")).alias("_words")))
    return (
        rows.select(F.explode(F.concat("_w", "_p")).alias("h"))
        .groupBy(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket"))
        .agg(F.count("*").alias(name))
    )


def ratio_table(texts: DataFrame, trusted: DataFrame) -> list[float]:
    """Log ratios by bucket, from ``text`` of the corpus and of the trusted documents."""
    raw = {r.bucket: r.raw for r in _counts(texts, "raw").collect()}  # at most BUCKETS rows
    target = {r.bucket: r.target for r in _counts(trusted, "target").collect()}
    share = sum(target.values()) / max(1, sum(raw.values()))
    if not share:
        return [0.0] * BUCKETS
    return [
        math.log((target.get(b, 0) + SMOOTHING) / (share * raw.get(b, 0) + SMOOTHING)) for b in range(BUCKETS)
    ]


def _repeats(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``_p``: words in windows found twice or more."""
    far = lambda i, by: F.get(F.col("_p"), i + by)
    windows = F.transform(
        F.slice("_p", F.lit(1), F.greatest(F.size("_p") - (WINDOW - 2), F.lit(0))),
        lambda p, i: F.xxhash64(p, far(i, 2), far(i, 4), far(i, 6)),
    )
    rows = rows.withColumn("_v", windows)
    again = F.size(F.array_distinct("_v")) < F.size("_v")
    placed = F.sort_array(F.transform("_v", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(again, placed))
    like = lambda s, j: F.coalesce(F.get(F.col("_s"), j)["v"] == s["v"], F.lit(False))
    twice = F.filter("_s", lambda s, j: like(s, j - 1) | like(s, j + 1))
    rows = rows.withColumn("_t", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twice, lambda s: s["i"]))))
    reach = F.transform(
        "_t", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_t"), j + 1) - i, F.lit(WINDOW)))
    )
    total = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def _score(ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    add = lambda a, h: a + F.get(table, F.pmod(h, F.lit(len(ratios))).cast("int"))
    total = F.aggregate("_p", F.aggregate("_w", F.lit(0.0), add), add)
    return F.when(F.size("_w") > 0, total / (F.size("_w") + F.size("_p"))).otherwise(F.lit(0.0))


def trusted_documents(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``text`` of the documents that a label calls good."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_good")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select(named(id_column).alias("_id"), named(text_column).alias("text")).join(
        ids, F.col("_id") == F.col("_good"), "left_semi"
    )


def rate_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    threshold: float = THRESHOLD, keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, or all) with the base counts, ``llr`` and ``kept``.

    A null text counts as empty. A text without words has an ``llr`` of 0 and fails the base.
    Without trusted documents every ratio is 0 and the base alone decides. Repeated rows are
    rated alike (each counts in the corpus); rows keep their order of columns, and input
    columns named like a result are replaced; an empty table gives an empty result.
    """
    names = keep or docs.columns
    return unpacked(_rated(docs, labels, id_column, text_column, threshold, names), names, OUTPUTS)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that :func:`rate_quality` keeps, all columns unchanged."""
    rated = _rated(docs, labels, id_column, text_column, threshold, docs.columns)
    return unpacked(rated.where("kept"), docs.columns)


def _rated(
    docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, threshold: float, names: list[str]
) -> DataFrame:
    """Rows packed in ``_row`` with the results beside it."""
    texts = docs.select(named(text_column).alias("text"))
    ratios = ratio_table(texts, trusted_documents(docs, labels, id_column, text_column))
    text = F.coalesce(named(text_column), F.lit(""))
    rows = packed(docs.select(*[named(c) for c in dict.fromkeys([*names, text_column])]), _text=text)
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(NOT_SPACE)))
    rows = rows.withColumns({"_lines": lines})
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    rows = _repeats(_hashed(rows)).withColumn("llr", F.round(_score(ratios), 6))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return settled(rows.select("_row", *OUTPUTS))
