"""The suffix tree against one built in plain Python."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import docs_of, prose, words

from wirelog.llm.queries import op11_suffix_tree
from wirelog.llm.suffix_tree import score_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = None


def tokens_of(text):
    return [*words((text or "").translate(LOWER)), END]


class Tree:
    """Contexts as tuples of words, each with the counts of what follows."""

    def __init__(self, texts, depth, min_count, divergence, weight):
        self.depth, self.weight = depth, weight
        self.follow = {}
        for text in texts:
            seen = tokens_of(text)
            for i, word in enumerate(seen):
                for d in range(min(depth, i) + 1):
                    self.follow.setdefault(tuple(seen[i - d : i]), Counter())[word] += 1
        self.follow.setdefault((), Counter())
        self.total, self.distinct = sum(self.follow[()].values()), len(self.follow[()])
        self.kept = {()}
        for d in range(1, depth + 1):
            for context, after in self.follow.items():
                count = sum(after.values())
                if len(context) != d or count < min_count:
                    continue
                gain = 0.0
                for word, n in after.items():
                    suffix = self.probability(self.state(context[1:]), word)
                    gain += n * math.log((n - 1 + weight * suffix) / (count - 1 + weight) / suffix)
                if gain >= divergence * count:
                    self.kept.add(context)

    def state(self, history):
        while history not in self.kept:
            history = history[1:]
        return history

    def probability(self, state, word):
        if not state:
            return (self.follow[()][word] + 1) / (self.total + self.distinct + 1)
        suffix = self.probability(self.state(state[1:]), word)
        after = self.follow[state]
        return (after[word] + self.weight * suffix) / (sum(after.values()) + self.weight)

    def rate(self, text):
        seen, score, base = tokens_of(text), 0.0, 0.0
        for i, word in enumerate(seen):
            score += math.log10(self.probability(self.state(tuple(seen[max(0, i - self.depth) : i])), word))
            base += math.log10(self.probability((), word))
        return len(seen), sum(w in self.follow[()] for w in seen), self.total, base, score


def compare(found, texts, train, **settings):
    tree = Tree([t for t, learnt in zip(texts, train) if learnt], **settings)
    assert len(found) == len(texts)
    for row in found:
        expected = tree.rate(texts[row.doc_id])
        assert (row.n_tokens, row.n_known, row.train_tokens) == expected[:3]
        assert (row.base_score, row.score) == pytest.approx(expected[3:], rel=1e-9, abs=1e-9)
        assert row.held_out != train[row.doc_id]
    return tree


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in docs}
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in texts}
    found = op11_suffix_tree(spark, "/root/testdata/sf0.001").collect()
    tree = Tree([texts[i] for i in texts if train[i]], 2, 16, 0.05, 8.0)
    assert {len(c) for c in tree.kept} == {0, 1, 2}
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for row in found:
        expected = tree.rate(texts[row.doc_id])
        assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (*expected[:3], not train[row.doc_id])
        assert (row.base_score, row.score) == pytest.approx(expected[3:], rel=1e-9, abs=1e-9)


def test_held_out_texts_are_predicted_better(spark):
    found = op11_suffix_tree(spark, "/root/testdata/sf0.01")
    row = found.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert row[0] > row[1] + 0.05 * row[2]


@pytest.mark.parametrize("depth", [1, 3])
def test_small_chunks_and_buckets(spark, depth):
    """One context holds most rows; every text is a chunk, and keys spread over many buckets."""
    texts = ["A b " * 30 + " ".join(prose(i % 5, 40, 6)) for i in range(24)]
    train = [i % 4 != 1 for i in range(24)]
    settings = dict(depth=depth, min_count=3, divergence=0.01, weight=2.0)
    df = docs_of(spark, texts)
    found = score_texts(df, F.col("doc_id") % 4 != 1, chunk_bytes=1, bucket_words=50, **settings).collect()
    tree = compare(found, texts, train, **settings)
    assert max(map(len, tree.kept)) == depth


def test_long_text_is_hashed_in_parts(spark):
    texts = [" ".join(prose(1, 900_000, 30)), "short text"]
    found = score_texts(docs_of(spark, texts), F.lit(True), keep=["doc_id"]).orderBy("doc_id").collect()
    assert [r.n_tokens for r in found] == [900_001, 3]
    assert found[0].n_known == 900_001


def test_nulls_empty_and_clashing_columns(spark):
    texts = [None, "", " \t\n", "a a A é", "a a A é"]
    settings = dict(depth=2, min_count=2, divergence=0.0, weight=1.0)
    df = docs_of(spark, texts).withColumn("score", F.lit("x")).withColumn("`odd.name", F.lit(1))
    found = score_texts(df, F.when(F.col("doc_id") > 2, True), **settings)
    assert "`odd.name" in found.columns and found.columns.count("score") == 1
    compare(found.collect(), texts, [False, False, False, True, True], **settings)
    nothing = score_texts(df, F.lit(None).cast("boolean"), **settings).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in nothing} == {(0, 0, 0.0)}
    assert score_texts(df.limit(0), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        score_texts(df, F.lit(True), min_count=1)
