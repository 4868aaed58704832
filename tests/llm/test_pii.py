import hashlib
import re

from helpers import docs_of, prose
from pyspark.sql import functions as F

from wirelog.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SF = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else sum(divmod(2 * digit, 10))
    return total % 10 == 0


def good(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if good(kind, m.group())
    ]


EDGES = [
    None, "", "é a@b.cc_x@y.zz a@b a.b@c.d@e.f 😀 x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.4 1.2.3.256",
    "4041894974608795 4041-8949 7460-8795 0000000000000000 12 3 4111 1111 1111 1111 5", "+1 (988) 555-2485 +1 +12 +1...2 ++44 20 7946 0958",
    "9" * 5000, "a" * 20000, "u@v.w " * 3000, "x@" + ".".join(["y"] * 4000), "mail\nme@here.org\r\n+1 (456) 555-2186",
    "1.2.3.4", "ends 4041894974608795",
]


def check(rows, texts):
    for row in rows:
        spans = base(texts[row.doc_id])
        counts = [sum(s.startswith(k + ":") for s in spans) for k in PLAIN]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts, row
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), row
        assert set(spans) <= set(row.spans.split(",")) | {""}


def test_base_spans_equal_plain_patterns(spark):
    docs = docs_of(spark, EDGES)
    check(pii.extract_pii(docs, keep=["doc_id"]).collect(), dict(enumerate(EDGES)))


def test_base_spans_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pii.extract_pii(docs, keep=["doc_id"]).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    check(rows, texts)


def test_contexts_of_seeds_discover_unseen_identifiers(spark):
    texts = [" ".join(prose(i, 30)).replace("x", "") + f" please dial number +1 (200) 555-1{i:03d} now" for i in range(12)]
    hidden = "nothing before please dial number 020-7946-0958 now and 2024-01-01 after"
    texts += [hidden, "the year 020-7946-1111 was fine", hidden.replace("0958", "0959")]
    rows = {r.doc_id: r.spans for r in pii.extract_pii(docs_of(spark, texts), keep=["doc_id"]).collect()}
    start = hidden.index("020")
    assert rows[12] == f"phone:{start}:{start + 13}" and rows[14] == rows[12]
    assert rows[13] == ""


def test_redaction_keeps_the_rest(spark):
    text = "é write to me@here.org or 10.0.0.1, not 999.1.1.1; pay 4041894974608795, call +1 (988) 555-2485 😀"
    docs = docs_of(spark, [text, None, "", "plain"]).withColumns({"_text": F.lit("mine"), "key": F.lit(1), "_cuts": F.lit(2)})
    rows = {r.doc_id: r for r in pii.redact_pii(docs).collect()}
    assert rows[0].text == "é write to <EMAIL> or <IP>, not 999.1.1.1; pay <CARD>, call <PHONE> 😀"
    assert rows[1].text is None and rows[2].text == "" and rows[3].text == "plain"
    assert rows[0]._text == "mine" and pii.redact_pii(docs).columns == docs.columns


def test_discovered_spans_are_redacted_in_place(spark):
    texts = [f"please dial number +1 (200) 555-1{i:03d} now é" for i in range(12)]
    texts.append("é😀 please dial number 020-7946-0958 now me@here.org")
    rows = {r.doc_id: r.text for r in pii.redact_pii(docs_of(spark, texts)).collect()}
    assert rows[12] == "é😀 please dial number <PHONE> now <EMAIL>"


def test_repeats_and_empty(spark):
    docs = docs_of(spark, ["a@b.cc", "a@b.cc"])
    both = pii.extract_pii(docs.union(docs))
    assert both.count() == 4 and both.where("spans = 'email:0:6'").count() == 4
    assert pii.extract_pii(docs.where("false")).count() == 0
    assert pii.redact_pii(docs.where("false")).count() == 0
