import random

import pytest
from helpers import docs_of, prose
from pyspark.sql import functions as F

from wirelog.llm import token_counts
from wirelog.llm.queries import tokenizer_path

TEXTS = [
    None, "", "  \n", "Hello, world's end! 😀 naïve café", "<|endoftext|> and <|startoftext|>x", "a" * 3000,
    "e\u0301 \u0301x ½ ﬁ", "\x00\x1f\u200b tab\tnew\nline", " ".join(prose(1, 3000)), "x" * 70_000,
    ("word " * 20_000) + "<|endoftext|>" + "y " * 30_000, "no-space," * 9000,
]


LIBRARY = token_counts.tokenizer(tokenizer_path())


def exact(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_equals_the_library(spark):
    rows = token_counts.count_tokens(docs_of(spark, TEXTS), tokenizer_path(), keep=["doc_id"], longest=2000).collect()
    for row in rows:
        text = TEXTS[row.doc_id] or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), exact(text)), row.doc_id
        assert row.over_limit == (row.n_tokens > 2048)


@pytest.mark.parametrize("seed", range(30))
def test_chunks_splice_exactly(seed):
    draw = random.Random(seed)
    parts = ["word", "Ünï", "'s", "<|endoftext|>", "123", "!?", "😀", "e\u0301", "x" * 40, "a-b"]
    gaps = [" ", "", "\n", "  ", "\u00a0", "\t"]
    text = "".join(draw.choice(parts) + draw.choice(gaps) for _ in range(400))
    encode = token_counts.tokenizer(tokenizer_path()).encode
    assert token_counts.count_long(encode, text, chunk=draw.choice([60, 150, 400]), overlap=draw.choice([4, 20, 60])) == exact(text)


def test_text_without_white_space_is_widened_to_the_end():
    encode = token_counts.tokenizer(tokenizer_path()).encode
    text = "abc" * 500
    assert token_counts.count_long(encode, text, chunk=100, overlap=10) == exact(text)


def test_clashing_names_repeats_and_empty(spark):
    docs = docs_of(spark, ["a b", "a b"]).withColumns({"n_bytes": F.lit("old"), "_row": F.lit(1)})
    counted = token_counts.count_tokens(docs.union(docs), tokenizer_path())
    assert counted.count() == 4 and counted.where("n_bytes = 3 AND n_tokens = 2 AND _row = 1").count() == 4
    assert token_counts.count_tokens(docs.where("false"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_words_add_up_to_the_text(seed, monkeypatch):
    """Special strings, letters that compose across borders, every kind of white space, a tiny memory."""
    monkeypatch.setattr(token_counts, "_KNOWN_WORDS", 40)
    monkeypatch.setattr(token_counts, "_KNOWN_LENGTH", 6)
    draw = random.Random(seed)
    parts = [
        "word", "Ünï", "'s", "don't", "<|endoftext|>", "<|startoftext|>x", "123", "!?", "😀", "e\u0301", "\u0301", "ΑΣ", "İ",
        "\u212b", "a-b", "<|endof", "text|>", "\x1c", "\x85", "\u200b", "ﬁ", "x" * 30,
    ]
    gaps = [" ", "", "\n", "  ", "\u00a0", "\t", "\r\n", "\u3000", "\x0b", "\x0c", "\u2028", "\x1f"]
    texts = ["".join(draw.choice(parts) + draw.choice(gaps) for _ in range(60)) for _ in range(30)]
    words = token_counts._Words(token_counts.tokenizer(tokenizer_path()))
    for start in range(0, 30, 10):
        assert words.count(texts[start : start + 10]) == [exact(t) for t in texts[start : start + 10]]
    assert len(words.known) <= 40 and max(map(len, words.known), default=0) <= 6


def test_which_tokenizers_drop_white_space():
    assert token_counts.drops_space(tokenizer_path())
    assert not token_counts.drops_space(tokenizer_path("byte_bpe_50k.json"))


def test_given_table_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tokenizer_path()).collect()}
    assert found == {r.doc_id: exact(r.text) for r in docs.collect()}
