import heapq
import random
from collections import defaultdict

import pytest
from helpers import docs_of, prose, words
from pyspark.sql import functions as F

from wirelog.llm import mixing


def shares(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    free, rest = set(order), 1.5 * sum(sizes.values())
    while rest > 1e-9 and free:
        total = sum(weight[s] for s in free)
        given = {s: rest * weight[s] / total for s in free}
        rest = 0.0
        for s in list(free):
            target[s] += given[s]
            if target[s] > 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def check(rows, texts, sources, block=mixing.BLOCK_WORDS):
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(words(t))
    target, taken, shards = shares(sizes), defaultdict(int), 0
    for r in rows:
        source = sources[r.doc_id]
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * block, (s, taken[s], target[s])


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r for r in docs.collect()}
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(known)
    texts, sources = [known[i].text for i in range(len(known))], [known[i].source for i in range(len(known))]
    check(rows, texts, sources)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_small_sources_nulls_and_many_shards(spark, monkeypatch):
    draw = random.Random(1)
    texts = [" ".join(prose(i, draw.randrange(0, 900))) for i in range(200)] + [None, "", " "]
    sources = [draw.choice(["a", "b", "B", "é", None, "tiny"][: 5 if i else 6]) for i in range(200)] + ["void", None, "a"]
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    rows = mixing.mix_sources(docs_of(spark, texts, sources)).collect()
    assert len(rows) == len(texts)
    check(rows, texts, sources, block=20 * mixing.BLOCK_WORDS)  # each shard ends in a partial block


def test_repeated_rows_and_empty(spark):
    docs = docs_of(spark, [" ".join(prose(1, 3000))]).withColumnRenamed("lang", "target")
    rows = mixing.mix_sources(docs.union(docs).union(docs)).collect()
    assert len(rows) == 3 and all(r.taken <= 2 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * 9000) <= 2 * mixing.BLOCK_WORDS
    assert mixing.mix_sources(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_seats_go_to_the_highest_quotients(spark, seed):
    draw = random.Random(seed)
    votes = [draw.choice([0, 1, draw.randrange(50), draw.randrange(10**6)]) for _ in range(draw.randrange(1, 40))]
    seats = draw.choice([0, 1, 7, 100, 5000])
    won, heap = [0] * len(votes), [(-float(v), i, 0) for i, v in enumerate(votes) if v]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i, k = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
    table = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, party int, votes bigint, seats bigint")
    rows = mixing.sainte_lague(table, ["g"], F.col("party"), "votes", "seats", "won").collect()
    assert {r.party: r.won for r in rows} == dict(enumerate(won))
