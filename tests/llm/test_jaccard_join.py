import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_of, prose, words

from wirelog.llm import jaccard_join
from wirelog.llm.hashing import shingles, word_hashes


def shingle_set(text):
    found = words(text)
    width = min(5, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set()


def brute(texts):
    """Class (least id of the component) and links of every text."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}
    links = dict.fromkeys(texts, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if not sets[a] or not sets[b] or min(len(sets[a]), len(sets[b])) < 0.8 * max(len(sets[a]), len(sets[b])):
            continue
        common = len(sets[a] & sets[b])
        if 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in texts}


def edited(seed, tokens, changes):
    draw, out = random.Random(seed), list(tokens)
    for _ in range(changes):
        out[draw.randrange(len(out))] = f"edit{draw.randrange(10**6)}"
    return out


def corpus():
    texts = [None, "", " \n ", "one", "one", "three short words", "three short words", "two words", "a b c d e"]
    for group in range(5):
        tokens = prose(group, 60 + 90 * group)
        texts += [" ".join(edited(s, tokens, s % 7)) for s in range(14)]
        texts.append("\n".join(tokens))
    texts += [" ".join(prose(99, 30) + prose(s, 30)) for s in range(20)]
    return dict(enumerate(texts))


@pytest.mark.parametrize("blocks", [None, 4])
def test_equals_all_pairs(spark, monkeypatch, blocks):
    texts = corpus()
    if blocks:
        monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", blocks)
    rows = jaccard_join.near_duplicates(docs_of(spark, list(texts.values()))).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == brute(texts)


def test_given_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = jaccard_join.near_duplicates(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == brute({r.doc_id: r.text for r in docs.collect()})


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(prose(7, 40))
    docs = docs_of(spark, [text, text + " more"])
    nulls = docs.selectExpr("CAST(NULL AS bigint) AS doc_id", "text", "lang AS digest", "source AS key", "n_chars AS n")
    rows = jaccard_join.near_duplicates(docs.union(docs)).collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 3), (0, 0, 3), (1, 0, 3), (1, 0, 3)]
    assert [tuple(r) for r in jaccard_join.near_duplicates(nulls).collect()] == [(None, None, 1)] * 2
    assert jaccard_join.near_duplicates(docs.where("false")).count() == 0


def test_word_hashes_follow_words():
    texts = pa.array(["", "a b", " é\tb\x0b", "x" * 5000 + " a", "b", "\n"], pa.string())
    hashes, starts = word_hashes(texts)
    found = [hashes[a:b].tolist() for a, b in zip(starts, starts[1:])]
    assert [len(f) for f in found] == [0, 2, 2, 2, 1, 0]
    assert found[1][1] == found[2][1] == found[4][0] and found[3][1] == found[1][0]
    assert len({*found[1], *found[2], *found[3]}) == 4
    sliced, edges = word_hashes(texts.slice(1, 2))
    assert sliced.tolist() == found[1] + found[2] and edges.tolist() == [0, 2, 4]
    assert len(shingles(np.arange(9, dtype=np.uint64))) == 5


def test_pruning_bounds_follow_the_posterior():
    needed = jaccard_join.least_matches(0.8, 1e-9)
    assert len(needed) == 8 and needed == sorted(needed) and needed[-1] < 0.8 * 128
    assert jaccard_join.least_matches(0.8, 0.5)[-1] > needed[-1]
