"""Spelling variants against a comparison of all pairs."""

import re
import zlib
from collections import Counter

import pytest


from wirelog.llm.queries import op13_spelling
from wirelog.llm.spelling import count_words, group_variants, near_words

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(rows, slip=97):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if mark % slip == 0:
                at = mark % len(word)
                word = word[:at] + word[at + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def pairs_by_hand(words):
    """Pairs one edit apart, by leaving out every letter in turn."""
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in near:
                near[w].add(short)
                near[short].add(w)
            holes.setdefault((i, short), []).append(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    return near


def expected(words):
    near = pairs_by_hand(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    result = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        result.add((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return result


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = rows_of(op13_spelling(spark, SF))
    assert len(found) == len(set(found))
    assert set(found) == expected(words_by_hand(docs))


def test_chains_ties_and_accents(spark):
    words = {
        "abcde": 100, "abcdf": 40, "abcdé": 100, "abcdff": 20, "abcdfff": 10, "xbcde": 50, "Ébcde": 3,
        "zzzzz": 7, "zzzzzz": 13, "kkkkk": 3, "kkkkkk": 6,
    }
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert set(rows_of(group_variants(df))) == expected(words)
    found = {r[0]: r for r in rows_of(group_variants(df))}
    assert found["abcdfff"][2] == "abcde" and found["xbcde"][1] == "abcde"


def test_crowded_letters(spark):
    """Thousands of words of the same letters: every pair is found once."""
    import itertools

    words = {"".join(p): 3 + i % 50 for i, p in enumerate(itertools.product("aent", repeat=5))}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    near = pairs_by_hand(words)
    found = [(r.a, r.b) for r in near_words(df).collect()]
    assert len(found) == len(set(found)) == sum(map(len, near.values())) // 2
    assert all(b in near[a] for a, b in found)


def test_nulls_empty_and_clashing_columns(spark):
    schema = "doc_id string, text string, word string, n int"
    assert rows_of(group_variants(count_words(spark.createDataFrame([], schema)))) == []
    rows = [(None, "House house HOUSE housÉ housÉ housÉ", "x", 1), ("1", None, None, None), ("1", "", "y", 2)]
    counted = {r.word: r.n for r in count_words(spark.createDataFrame(rows, schema)).collect()}
    assert counted == {"house": 3, "housÉ": 3}
    slipped = count_words(spark.createDataFrame(rows * 2, schema), slip=1)
    assert {r.word: r.n for r in slipped.collect()} == words_by_hand([(r[0], r[1]) for r in rows * 2], slip=1)
    with pytest.raises(ValueError):
        group_variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_no_table_is_broadcast(spark, tmp_path):
    """Stored words look small to Spark, and eighteen rows come of each: none may go to the driver."""
    words = {"abcde": 100, "abcdf": 40, "abcdff": 20, "abcdfff": 10, "xbcde": 50, "zzzzz": 7}
    spark.createDataFrame(list(words.items()), "word string, n long").write.parquet(str(tmp_path / "words"))
    stored = spark.read.parquet(str(tmp_path / "words"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        assert set(rows_of(group_variants(stored))) == expected(words)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
