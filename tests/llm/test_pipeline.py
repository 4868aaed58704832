import corpus_pipeline
import pytest
from helpers import docs_of, prose
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_run_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:])) and set(rows[2]) == set(rows[3])
    mixed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in mixed} == set(rows[3])


@pytest.fixture
def odd(spark):
    texts = [None, "", " ", "x" * 40_000, " ".join(prose(1, 20_000)), " ".join(prose(2, 50)), " ".join(prose(2, 50)), "a@b.cc " * 30]
    docs = docs_of(spark, texts)
    return docs.union(docs).union(docs.limit(6).withColumn("doc_id", F.lit(None).cast("bigint"))).withColumns(
        {"digest": F.lit(1), "_row": F.lit(2), "key": F.lit(None).cast("string"), "n_words": F.lit("w"), "a.b": F.lit(3)}
    )


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_bear_odd_rows(spark, odd, stage):
    out = stage[1](spark, odd, SF)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert stage[1](spark, odd.where("false"), SF).count() == 0


def test_mixing_bears_odd_rows(spark, odd):
    assert corpus_pipeline.source_mixing(spark, odd, SF).count() == odd.count()


def test_near_duplicates_keep_the_first_of_each_group(spark):
    text = " ".join(prose(3, 80))
    docs = docs_of(spark, [text, text + " tail", "other words entirely here now", None, text])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 2, 3]
