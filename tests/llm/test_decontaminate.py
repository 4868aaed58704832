import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from helpers import docs_of, prose
from pyspark.sql import functions as F

from wirelog.llm import decontaminate

ITEMS = "item_id bigint, text string"


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), ITEMS)


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    items = [" ".join(prose(1000 + i, 15 + i % 45)) for i in range(40)] + [None, "", "too short one", "just five words right here"]
    draw = random.Random(5)
    texts, leaky = [], set()
    for i in range(120):
        body = prose(i, draw.randrange(5, 300))
        if i % 3 == 0:
            passage = items[i % 40].split()
            if i % 2:  # about one word in eight replaced
                for at in range(draw.randrange(8), len(passage), 8):
                    passage[at] = f"other{at}"
            at = draw.randrange(len(body) + 1)
            body[at:at] = [w.upper() + "," for w in passage]
            leaky.add((i, i % 40))
        texts.append(("\n" if i % 2 else " ").join(body))
    texts += [None, "", "He said: just five words right here.", " ".join(prose(1000, 12))]
    found = decontaminate.find_leaks(docs_of(spark, texts), items_of(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaky | {(122, 43)}
    kept = decontaminate.drop_leaking(docs_of(spark, texts), items_of(spark, items))
    assert {r.doc_id for r in kept.collect()} == set(range(124)) - {d for d, _ in leaky} - {122}


def test_given_table_has_every_verbatim_passage(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    bodies = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    planted = {(d, i.item_id) for i in items.collect() for d, t in bodies.items() if " ".join(i.text.split()) in t}
    assert planted and planted <= found
    for doc, item in found - planted:  # anything else shares at least eight words in a row
        tokens = items.where(F.col("item_id") == item).first().text.split()
        assert any(" ".join(tokens[k : k + 6]) in bodies[doc] for k in range(len(tokens) - 5))


def test_places_and_matches(spark):
    item = prose(1, 20)
    changed = item[:9] + ["else"] + item[10:]
    docs = docs_of(spark, [" ".join(["before", "-", "it"] + changed + ["after"])])
    row = decontaminate.find_leaks(docs, items_of(spark, [" ".join(item)])).first()
    assert (row.first_token, row.end_token, row.matched) == (2, 22, 19)


def test_blocks_give_the_same_leaks(spark, monkeypatch):
    items = [" ".join(prose(i, 30)) for i in range(30)]
    docs = docs_of(spark, [" ".join(prose(50 + i, 20)) + " " + items[i] for i in range(30)])
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 300)
    found = decontaminate.find_leaks(docs, items_of(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(30)]


def test_repeats_clashes_and_empty_tables(spark):
    item = " ".join(prose(1, 20))
    docs = docs_of(spark, [item]).withColumn("matched", F.lit("x"))
    items = items_of(spark, [item]).withColumn("doc_id", F.lit(5))
    assert decontaminate.find_leaks(docs.union(docs), items).count() == 2
    assert decontaminate.find_leaks(docs, items.union(items.withColumn("item_id", F.lit(7)))).count() == 2
    assert decontaminate.find_leaks(docs.where("false"), items).count() == 0
    assert decontaminate.find_leaks(docs, items.where("false")).count() == 0
    assert decontaminate.drop_leaking(docs, items.where("false")).columns == docs.columns


def brute_stretch(same, least, share):
    """The same by trying every stretch: most matches, shortest, earliest."""
    found = [
        (-sum(same[a:b]), b - a, a)
        for a in range(len(same)) for b in range(a + least, len(same) + 1)
        if b - a - sum(same[a:b]) <= share * (b - a) + 1e-9 and any(same[a:b])
    ]
    return min(found) if found else None


def test_stretches_equal_brute_force():
    draw = random.Random(3)
    for _ in range(600):
        same = [draw.random() < draw.choice((0.6, 0.8, 0.9)) for _ in range(draw.randrange(1, 45))]
        least = draw.choice((5, 13))
        found = decontaminate.best_stretch(np.array(same), least, 0.2)
        expected = brute_stretch(same, least, 0.2)
        assert (found is None) == (expected is None), same
        if found:
            assert (-found[2], found[1] - found[0]) == expected[:2], same
            assert sum(same[found[0] : found[1]]) == found[2]


def test_substitutions_anywhere_up_to_a_fifth_are_found():
    """Every placement for 13 and 15 words, random ones beyond, inside other words."""
    draw = random.Random(4)
    for count in (13, 14, 15, 16, 19, 20, 25, 40):
        item = prose(count, count)
        block = decontaminate.build_block([0], [" ".join(item)], 13, 0.2)
        placed = list(combinations(range(count), count // 5))
        if len(placed) > 1000:
            placed = [draw.sample(range(count), count // 5) for _ in range(1000)]
        texts = [" ".join(["x", "y"] + [f"sub{i}" if i in at else w for i, w in enumerate(item)] + ["z"]) for at in placed]
        found = {f[0] for f in decontaminate.overlaps(pa.array(texts, pa.large_string()), block)}
        assert len(found) == len(texts), (count, len(texts) - len(found))
        clean = " ".join(f"sub{i}" if i < count - 10 else w for i, w in enumerate(item))
        over = " ".join(f"sub{i}" if i % 3 == 2 else w for i, w in enumerate(item))
        for text in (clean, over):
            assert not list(decontaminate.overlaps(pa.array([text], pa.large_string()), block))


def test_short_items_are_found_whatever_word_differs():
    """Items of 1 to 12 words: every placement up to a fifth is found, one word more is not."""
    for count in range(1, 13):
        item = prose(count, count)
        block = decontaminate.build_block([0], [" ".join(item)], 13, 0.2)
        for differ in (count // 5, count // 5 + 1):
            for at in combinations(range(count), differ):
                words = [f"sub{i}" if i in at else w for i, w in enumerate(item)]
                found = list(decontaminate.overlaps(pa.array([" ".join(["x", *words, "y"])], pa.large_string()), block))
                expected = [(0, 0, 1, 1 + count, count - differ)] if differ == count // 5 else []
                assert found == expected, (count, at)
        cut = pa.array([" ".join(item[1:]), " ".join(item[:-1])], pa.large_string())
        assert not list(decontaminate.overlaps(cut, block))
