import random

from pyspark.sql import functions as F

from wirelog.llm import url_filter

PAGES = "page_id bigint, url string"


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    end = next((i for i, c in enumerate(rest[cut:], cut) if c in "?#"), len(rest))
    path, best = rest[cut:end], None
    for kind, entry in url_filter.RULES:
        domain, _, tail = entry.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail):
            if best is None or len(entry) > len(best[1]):
                best = (kind, entry)
    return host, path, best


URLS = [
    None, "", "example.net/en/", "http://Foo.NET/x?y#z", "http://example.net/en/a", "http://a.example.net/de/", "http://net",
    "http://net/", "http://xnet/", "http://É.ORG/fr/É?q=://", "http://org/fr", "http://b.org/fr/x", "http://example.com/de/",
    "http://a.b.example.com/de/1", "http://badexample.com/de/", "a://b://c/d", "http://user@h.net:80/", "://", "http://h\n.net/", "x://?net/",
    "http://" + "a" * 30000 + ".net/" + "1" * 30000,
]


def test_hosts_paths_and_rules(spark):
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(URLS)), PAGES), trees=2).collect()
    assert len(rows) == len(URLS)
    for row in rows:
        host, path, best = brute(URLS[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, best and best[1]), URLS[row.page_id]
        assert row.verdict == best[0] if best else row.verdict in ("allow", "block")


def test_given_table_and_reruns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    first = sorted(map(tuple, url_filter.filter_urls(pages).drop("score").collect()))
    assert first == sorted(map(tuple, url_filter.filter_urls(pages.repartition(5)).drop("score").collect()))
    urls = {r.page_id: r.url for r in pages.collect()}
    assert all((h, p) == brute(urls[i])[:2] for i, h, p, _, _ in first)


def test_trees_learn_lexical_features(spark):
    draw = random.Random(2)

    def make(bad):
        name = "".join(draw.choice("abcdefgh" if not bad else "0123456789-x") for _ in range(8 if not bad else 25))
        tail = "&".join(f"k{i}={draw.randrange(10**6)}" for i in range(6 if bad else draw.randrange(2)))
        return f"http://{name}.example.org/p{draw.randrange(9)}?{tail}"

    rows = [(make(i % 2 == 1), float(i % 2)) for i in range(400)]
    host, path = url_filter.split_url(F.col("url"))
    table = spark.createDataFrame(rows, "url string, label double").withColumns({"host": host, "path": path})
    train, held = table.where("xxhash64(url) % 2 = 0"), table.where("xxhash64(url) % 2 <> 0")
    judged = url_filter.judge_urls(held, url_filter.train_url_model(train, trees=5))
    right = judged.where((F.col("score") >= 0.5) == (F.col("label") == 1)).count()
    assert right >= 0.95 * judged.count() > 100


def test_one_kind_of_label_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (2, "http://b.info/")], PAGES).withColumn("label", F.lit("x"))
    assert sorted(tuple(r)[4] for r in url_filter.filter_urls(pages).collect()) == ["block"] * 3
    assert url_filter.filter_urls(pages.where("page_id = 2")).first().verdict == "allow"
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_every_suffix_has_its_own_statistics(spark):
    rows = [(f"http://a.site{i:04}.org/", float(i % 2)) for i in range(1200)]
    host, path = url_filter.split_url(F.col("url"))
    table = spark.createDataFrame(rows, "url string, label double").withColumns({"host": host, "path": path})
    model = url_filter.train_url_model(table, trees=1)
    rates = {r.suffix: r.suffix_rate for r in model.suffixes.collect()}
    assert rates == {f"site{i:04}.org": (i % 2 + 0.5) / 2 for i in range(1200)}
