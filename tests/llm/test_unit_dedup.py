import random

from helpers import docs_of, prose
from pyspark.sql import functions as F

from wirelog.llm import unit_dedup


def sentences(seed, count):
    draw = random.Random(seed)
    return [" ".join(prose(seed * 1000 + i, draw.randrange(2, 12))).capitalize() + "." for i in range(count)]


def brute(texts, unit, least):
    """Removed passages by walking the documents in order."""
    seen, out = {}, set()
    for doc, text in sorted(texts.items()):
        run = []
        for start, end, count, digest in list(unit_dedup.units_of(text or "", unit)) + [(None, None, 0, None)]:
            if digest is not None and digest in seen and seen[digest] != (doc, start):
                run.append((start, end, count, seen[digest]))
                continue
            if run and sum(r[2] for r in run) >= least:
                out.add((doc, run[0][0], run[-1][1], len(run), sum(r[2] for r in run), *run[0][3]))
            run = []
            if digest is not None:
                seen[digest] = (doc, start)
    return out


def test_equals_brute_force_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for unit in ("sentence", "line", "paragraph"):
        found = unit_dedup.repeated_passages(docs, unit=unit).collect()
        assert len(found) == len(set(found)) and {tuple(r)[:7] for r in found} == brute(texts, unit, unit_dedup.MIN_WORDS)


def test_planted_passages_inside_lines_go_and_clean_documents_stay(spark):
    passage = " ".join(sentences(77, 12))
    texts = [" ".join(sentences(i, 20)) for i in range(30)]
    hit = {3: 0, 11: 50, 12: 9999}
    for doc, at in hit.items():
        body = texts[doc]
        at = min(len(body), body.find(". ", at) + 2 if at < len(body) else len(body))
        texts[doc] = f"{body[:at]} {passage.upper() if doc == 12 else passage} {body[at:]}"
    texts[20] = texts[21] = "All rights reserved. " + texts[20]
    found = unit_dedup.repeated_passages(docs_of(spark, texts + [None, "", "\n\n"])).collect()
    assert {r.doc_id for r in found} == {11, 12, 21}
    assert {r.kept_doc_id for r in found if r.doc_id != 21} == {3}
    cleaned = unit_dedup.remove_passages(docs_of(spark, texts), spark.createDataFrame(found)).collect()
    for row in cleaned:
        spans = [tuple(map(int, s.split(":"))) for s in row.removed_spans.split(",") if s]
        assert spans == sorted((r.start, r.end) for r in found if r.doc_id == row.doc_id)
        original, rest, at = texts[row.doc_id], "", 0
        for a, b in spans:
            rest, at = rest + original[at:a], b
        assert row.text == rest + original[at:]


def test_offsets_are_code_points_and_units_cover_the_text():
    text = "É😀 one. Two v1.2 here!  \nThree?! last\n\n...\nend"
    for unit in ("sentence", "line", "paragraph"):
        cut = list(unit_dedup.units_of(text, unit))
        assert all(a < b for a, b, _, _ in cut) and cut[-1][1] == len(text)
    assert [text[a:b].strip() for a, b, _, _ in unit_dedup.units_of(text, "sentence")] == [
        "É😀 one.", "Two v1.2 here!", "Three?!", "last", "end",
    ]


def test_repeats_null_ids_and_empty(spark):
    text = " ".join(sentences(1, 15))
    docs = docs_of(spark, [text])
    assert unit_dedup.repeated_passages(docs.union(docs)).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert unit_dedup.repeated_passages(docs.union(nulls).union(nulls)).count() == 0
    assert unit_dedup.repeated_passages(docs.where("false")).count() == 0
    clash = docs_of(spark, [text, text]).withColumnRenamed("lang", "digest")
    assert [(r.doc_id, r.start, r.end) for r in unit_dedup.repeated_passages(clash).collect()] == [(1, 0, len(text))]


def test_short_units_and_passages_in_mid_sentence_go(spark):
    passage = " ".join(sentences(77, 3))
    own = ["".join(sentences(i, 1)) for i in range(900, 906)]
    texts = [
        f"{own[0]} {passage} {own[1]}",
        f"unfinished words of the host {passage} {own[2]}",  # the first sentence merges with the host's
        f"{own[3]} {passage[:-1]} and the host goes on.",  # the last one does
        "Short one. Alpha beta gamma.",
        "Short one. Alpha delta epsilon.",  # two words are no passage: the like beginning stays
        f"{own[4]} {passage.split('. ')[1]}.",
    ]
    docs = docs_of(spark, texts)
    found = unit_dedup.whole_passages(docs)
    assert {r.doc_id: r.text.split() for r in unit_dedup.remove_passages(docs, found).collect()} == {
        0: texts[0].split(), 1: f"unfinished words of the host {own[2]}".split(), 2: f"{own[3]}. and the host goes on.".replace("..", ".").split(),
        3: texts[3].split(), 4: ["Alpha", "delta", "epsilon."], 5: own[4].split(),
    }
    counts = {r.doc_id: r.n_words for r in found.collect()}
    assert counts == {1: len(passage.split()), 2: len(passage.split()), 4: 2, 5: len(passage.split(". ")[1].split())}
    twice = unit_dedup.whole_passages(docs.union(docs)).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, found.collect()))


def test_passages_that_meet_share_no_word(spark):
    a, b, c = "One two three four five.", "Alpha beta gamma delta epsilon zeta.", "Six seven eight nine ten."
    cut = " ".join(b.split()[:4])
    docs = docs_of(spark, [f"{a} {cut} other. Else. {' '.join(b.split()[1:])} {c}", f"{a} {b} {c}"])
    rows = sorted((r.start, r.end) for r in unit_dedup.whole_passages(docs).where("doc_id = 1").collect())
    assert rows and all(x[1] <= y[0] for x, y in zip(rows, rows[1:]))
    assert sum(r.n_words for r in unit_dedup.whole_passages(docs).where("doc_id = 1").collect()) == 16


def test_different_texts_of_one_id_keep_one_copy_of_each_sentence(spark):
    alpha, zulu, common = "Alpha beta gamma delta one.", "Zulu yankee xray whiskey two.", "Common to both of them here."
    docs = docs_of(spark, [f"{alpha} {common}", f"{zulu} {common}", f"{alpha} {zulu}"])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") < 2, 1).otherwise(2))
    for _ in range(2):
        left = " ".join(r.text for r in unit_dedup.remove_passages(docs, unit_dedup.whole_passages(docs)).collect())
        assert [left.count(s) for s in (alpha, zulu, common)] == [1, 1, 1]


def grown_by_hand(texts):
    """``whole_passages``: passages of ``brute`` and, at both ends, the words that stand beside the first occurrence alike."""
    seen, out = {}, []
    cut = {doc: list(unit_dedup.worded_units(text or "", "sentence")) for doc, text in texts.items()}
    for doc in sorted(cut):
        for number, (start, _, words) in enumerate(cut[doc]):
            seen.setdefault(tuple(words), (doc, number))
    def common(doc, number, kept_doc, kept_number, step):
        at, kept_at = number + step, kept_number + step
        if not (0 <= at < len(cut[doc]) and 0 <= kept_at < len(cut[kept_doc])):
            return 0
        a, b = (words[::-1] if step < 0 else words for words in (cut[doc][at][2], cut[kept_doc][kept_at][2]))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n if n >= unit_dedup.EDGE_WORDS else 0
    for doc in sorted(cut):
        run = []
        for number, (start, end, words) in enumerate(cut[doc] + [(None, None, None)]):
            kept = seen[tuple(words)] if words is not None else None
            if kept is not None and kept != (doc, number):
                run.append((number, kept))
                continue
            if run:
                left = common(doc, run[0][0], *run[0][1], -1)
                right = common(doc, run[-1][0], *run[-1][1], 1)
                inner = sum(len(cut[doc][n][2]) for n, _ in run)
                out.append((doc, run[0][0], run[-1][0], left, right, inner))
            run = []
    return out


def test_grown_passages_equal_brute_force_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = grown_by_hand(texts)
    found = sorted(unit_dedup.whole_passages(docs).collect(), key=lambda r: (r.doc_id, r.end))
    by_doc = {}
    for doc, first, last, left, right, inner in expected:
        by_doc.setdefault(doc, []).append((first, last, left, right, inner))
    assert len(found) == len(expected)
    grown = 0
    for row in found:
        first, last, left, right, inner = by_doc[row.doc_id].pop(0)
        cut = list(unit_dedup.worded_units(texts[row.doc_id] or "", "sentence"))
        text = texts[row.doc_id]
        grown += bool(left or right)
        if not left:
            assert row.start >= cut[first][0]
        assert row.end >= cut[last][1] and (right or row.end == cut[last][1])
        words = text[row.start : row.end].lower().translate(unit_dedup._PUNCTUATION).split()
        assert row.n_words == len(words) <= left + inner + right
        assert len(words) == left + inner + right or row.start > cut[first - 1][0]
    assert grown > 0
