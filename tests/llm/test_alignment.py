"""Token alignment against a loop over bytes."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.helpers import docs_of

from wirelog.llm.alignment import ByteLevel, Csr, Pieces, align_tokens, row_products, token_links, transposed
from wirelog.llm.queries import op12_alignment, tokenizer_path

A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def encoded(texts):
    """Tokens by the file's own library: lists of (id, bytes) of both sides, empty where a side loses bytes."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    table = ByteLevel(A_PATH).bytes
    assert decoders.ByteLevel().decode([a.id_to_token(995)]).encode() == table[995]
    for text in texts:
        whole = b" " + (text or "").encode()
        ids_a = [(i, table[i]) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        ids_b = []
        for i in b.encode(text or ""):
            piece = b.id_to_piece(i)
            ids_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        good = text and all(b"".join(x for _, x in ids) == whole for ids in (ids_a, ids_b))
        yield (ids_a, ids_b) if good else ([], [])


def by_hand(texts):
    links, groups, sizes = [], [], []
    for ids_a, ids_b in encoded(texts):
        owner = [[j for j, (_, x) in enumerate(ids) for _ in x] for ids in (ids_a, ids_b)]
        links.append(sorted(set(zip(*owner))))
        ends = []
        for ids in (ids_a, ids_b):
            at, found = 0, {}
            for j, (_, x) in enumerate(ids):
                at += len(x)
                found[at] = j + 1
            ends.append(found)
        written, a, b = [], 0, 0
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            written.append((ids_a[a : ends[0][cut]], ids_b[b : ends[1][cut]]))
            a, b = ends[0][cut], ends[1][cut]
        groups.append(written)
        sizes.append((ids_a, ids_b))
    count = Counter((a[i][0], b[j][0]) for (a, b), found in zip(sizes, links) for i, j in found)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    rows = []
    for (a, b), found, written in zip(sizes, links, groups):
        pairs = [(a[i][0], b[j][0]) for i, j in found]
        text = ";".join(
            ",".join(str(i) for i, _ in x) + "|" + ",".join(str(i) for i, _ in y) for x, y in written
        )
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        best = sum(count[p] == highest[p[1]] for p in pairs)
        rows.append((len(a), len(b), len(written), len(found), best, sum(count[p] for p in pairs), digest))
    return rows, links, groups


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r[n] for n in NAMES) for r in op12_alignment(spark, "/root/testdata/sf0.001").collect()}
    expected, _, _ = by_hand([r.text for r in docs])
    assert found == dict(zip([r.doc_id for r in docs], expected))


TEXTS = [
    None, "", " ", "a", "Plain words here.", "  two  spaces \n\n\n lines\t\ttabs ", "naïve café – 東京 ☃ 😀 ÉÀ",
    "▁under", "<|endoftext|> and <s> </s> <unk> <0x41>", "x" * 300, "   odd spaces", "é ﬁ Å",
    "Plain words here.", "l'été don't we'll 12345 67 ", "\x00\x01 control", "ZzZ" * 50 + "!?" * 40,
]


def test_odd_texts_small_chunks(spark):
    expected, links, groups = by_hand(TEXTS)
    df = docs_of(spark, TEXTS)
    for size in (1, 1 << 22):
        rows = align_tokens(df, A_PATH, B_PATH, keep=["doc_id"], chunk_bytes=size).collect()
        assert [tuple(r[n] for n in NAMES) for r in sorted(rows, key=lambda r: r.doc_id)] == expected
    found = defaultdict(list)
    for r in token_links(df, A_PATH, B_PATH, keep=["doc_id"]).collect():
        found[r.doc_id].append((r.a_place, r.b_place))
        assert r.shared_bytes > 0
    assert [sorted(found[i]) for i in range(len(TEXTS))] == links
    shared = Counter(r.doc_id for r in token_links(df, A_PATH, B_PATH, "group", keep=["doc_id"]).collect())
    assert [shared[i] for i in range(len(TEXTS))] == [sum(len(x) * len(y) for x, y in g) for g in groups]
    with pytest.raises(ValueError):
        token_links(df, A_PATH, B_PATH, "word")


def test_faster_ids_are_the_library_s():
    import random

    draw = random.Random(5)
    letters = "abcXYZ 019.,'\n\t\r éß東😀́​-_<|>▁"
    coder = ByteLevel(A_PATH)
    assert coder.fast is not None
    for size in [1, 2, 3, 5, 9, 30, 200] * 60:
        text = "".join(draw.choice(letters) for _ in range(size))
        assert coder.encode(text) == coder.library.encode(text, add_special_tokens=False).ids
    for text in ("", " " * 3000, "a" * 3000, "\n" * 50 + "x", "don't 'S 'll"):
        assert coder.encode(text) == coder.library.encode(text, add_special_tokens=False).ids


def test_products_equal_dense_ones():
    draw = np.random.default_rng(3)
    for rows, inner, columns, share in ((1, 1, 1, 1.0), (7, 5, 9, 0.4), (30, 20, 10, 0.1), (4, 6, 3, 0.0)):
        left, right = draw.random((rows, inner)) < share, draw.random((columns, inner)) < share
        sparse = []
        for dense in (left, right):
            starts = np.concatenate([[0], np.cumsum(dense.sum(axis=1))]).astype(np.int64)
            sparse.append(Csr(starts, np.nonzero(dense)[1], inner))
        for block in (1, 7, 1 << 20):
            product = np.zeros((rows, columns), np.int64)
            for i, j, value in row_products(sparse[0], transposed(sparse[1]), block):
                assert (product[i, j] == 0).all()
                product[i, j] = value
            assert (product == left.astype(int) @ right.astype(int).T).all()


def test_empty_table_and_clashing_columns(spark):
    df = docs_of(spark, ["one two", "one two"]).selectExpr("doc_id as n_a", "text", "'x' as `chunk.links`", "1 as rows")
    found = align_tokens(df, A_PATH, B_PATH).collect()
    assert [(r.n_a, r.n_links, r["chunk.links"], r.rows) for r in found] == [(2, 2, "x", 1)] * 2
    assert align_tokens(df.limit(0), A_PATH, B_PATH).collect() == []
    assert token_links(df.limit(0), A_PATH, B_PATH).collect() == []
    assert Pieces(B_PATH).bytes[0x41 + 3] == b"A"
