"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelog.llm import (
    alignment,
    decontaminate,
    jaccard_join,
    mixing,
    oracles,
    pii,
    quality,
    secrets,
    spelling,
    suffix_tree,
    token_counts,
    unit_dedup,
    url_filter,
    warc,
)

TOKENIZER_FILE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.rate_quality(documents, labels, keep=["doc_id"])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract_pii(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Splits far smaller than an archive: records are found from places in the middle of it.
    return warc.archive_pages(_table(spark, sf_dir, "pages"), split_bytes=1 << 20).withColumns(
        {c: F.col(c).cast("long") for c in ("page_id", "refers_to")}
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.whole_passages(_table(spark, sf_dir, "documents"))


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return suffix_tree.score_texts(documents, mark != 2, keep=["doc_id"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.align_tokens(_table(spark, sf_dir, "documents"), *files, keep=["doc_id"])


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), slip=97)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_pii, op3_url_filter, op4_jaccard_join, op5_secrets, op6_token_counts, op7_warc,
        op8_decontamination, op9_mixing, op10_unit_dedup, op11_suffix_tree,
        op12_alignment, op13_spelling,
    )
}
ORACLES = {
    "op4_jaccard_join": oracles.JACCARD_JOIN,
    "op7_warc": oracles.WARC,
    "op13_spelling": oracles.SPELLING,
}
