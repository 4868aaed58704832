"""URL filter: block and allow lists first, gradient-boosted trees for the rest.

Trees are trained on URLs that carry a label, here those that a list entry decides, from
lexical features alone: lengths, depth, digit ratio, entropy, parameters and the statistics of
the host's suffix. At most ``SAMPLE_ROWS`` labelled URLs, chosen by hash, train the trees; the
suffix statistics cover every labelled URL and every URL is judged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.llm.frames import Scratch, named

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled URLs that train the trees, at most.
SAMPLE_ROWS = 20_000
TREES = 12
DEPTH = 4
FEATURES = (
    "url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "letter_entropy",
    "parameters", "hyphens", "suffix_rate", "suffix_count",
)


@dataclass
class UrlModel:
    trees: object | None
    suffixes: DataFrame
    rate: float


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/?#`` or the end, A-Z in lower case; then up to ``?#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest list entry that fits (of equals the first by code points) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for kind, entry in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        domain, slash, rest = entry.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, entry).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _lexical(urls: DataFrame) -> DataFrame:
    """``urls`` has ``url``, ``host`` and ``path``; adds the features that need no statistics."""
    url, host, path = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "host", "path"))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring(url, F.instr(url, "?") + 1, F.length(url)), "#", 1)).otherwise("")
    letters = F.split(host, "")
    counted = F.transform(F.array_distinct(letters), lambda c: F.size(letters) - F.size(F.array_remove(letters, c)))
    total = F.greatest(F.length(host), F.lit(1))
    entropy = F.aggregate(counted, F.lit(0.0), lambda acc, n: acc - F.when(n > 0, n / total * F.log2(n / total)).otherwise(0.0))
    count_of = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return urls.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length(host),
            "path_length": F.length(path),
            "labels": count_of(host, r"\.") + 1,
            "depth": F.size(F.array_remove(F.split(path, "/"), "")),
            "digit_ratio": count_of(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "letter_entropy": F.round(entropy, 9),
            "parameters": F.size(F.array_remove(F.split(query, "&"), "")),
            "hyphens": count_of(host, "-"),
            "suffix": F.substring_index(host, ".", -2),
        }
    )


def _with_suffixes(lexical: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    return (
        lexical.join(suffixes, "suffix", "left")
        .withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(rate)), "suffix_count": F.coalesce("suffix_count", F.lit(0.0))})
    )


def train_url_model(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Train on ``url``, ``host``, ``path`` and ``label`` (1.0: block, 0.0: allow).

    Without labelled rows of both kinds there are no trees, and the more frequent label (allow
    when there is none) is the answer for every URL.
    """
    lexical = _lexical(labelled)
    blocked, total = labelled.agg(F.sum("label"), F.count("label")).first()
    rate = (blocked or 0.0) / total if total else 0.0
    # Written, so that the join shuffles both sides anew and can split a common suffix.
    suffixes = Scratch(labelled.sparkSession, "url-filter").store(
        lexical.groupBy("suffix")
        .agg(F.sum("label").alias("b"), F.count("*").alias("n"))
        .select(
            "suffix",
            ((F.col("b") + rate) / (F.col("n") + 1)).alias("suffix_rate"),
            F.log2(F.col("n") + F.lit(1.0)).alias("suffix_count"),
        ),
        "suffixes",
    )
    if not blocked or blocked == total:
        return UrlModel(None, suffixes, rate)
    ready = _with_suffixes(lexical, suffixes, rate)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready)
    # one ordered partition of a bounded number of rows: the same trees on every run
    sample = vectors.select("features", "label").orderBy(F.xxhash64("url"), "url").limit(sample_rows).coalesce(1)
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, seed=7)
    return UrlModel(learner.fit(sample), suffixes, rate)


def judge_urls(urls: DataFrame, model: UrlModel) -> DataFrame:
    """``urls`` (``url``, ``host``, ``path`` and more) with ``score``, the chance of ``block``."""
    ready = _with_suffixes(_lexical(urls), model.suffixes, model.rate)
    if model.trees is None:
        return ready.withColumn("score", F.lit(1.0 if model.rate > 0.5 else 0.0)).select(*urls.columns, "score")
    from pyspark.ml.functions import vector_to_array

    scored = model.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*urls.columns, "score")


def filter_urls(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, threshold: float = 0.5,
    sample_rows: int = SAMPLE_ROWS, trees: int = TREES,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` per row of ``pages``.

    A list entry decides where one fits; elsewhere the trees do, and a score of the threshold
    or more blocks. Null URLs and URLs without ``://`` have an empty host and path and are
    judged by the trees like others. Repeated rows are judged alike; an empty table gives an
    empty result; other columns are not read.
    """
    host, path = split_url(named(url_column))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select(
        named(id_column).alias("page_id"), named(url_column).cast("string").alias("url"), host.alias("host"), path.alias("path")
    ).withColumns({"rule": rule, "listed": verdict})
    labelled = urls.where("listed IS NOT NULL").select(
        "url", "host", "path", (F.col("listed") == "block").cast("double").alias("label")
    )
    judged = judge_urls(urls, train_url_model(labelled, sample_rows, trees))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
