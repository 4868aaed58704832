"""Personal data by bootstrapped contextual extraction.

Patterns for four kinds of identifier give the seed entities. Every word with a digit or an at
sign that no seed covers is a candidate. Seeds and candidates are instances; the words beside
them, together with a coarse shape, are lexical patterns; who occurs with whom is a graph of patterns and
instances. In each round a pattern is worth the mean worth of its distinct instances for a
kind, if enough of them are worth something, and a candidate the mean worth of its good patterns. Seeds stay
worth 1 for their kind and 0 for others. Candidates in contexts of high-confidence patterns
are extracted. Worth is counted in whole millionths, so every run gives the same spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelog.llm.frames import Scratch, named, packed, settled, text_key, unpacked
from wirelog.llm.spans import listed, located

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Distinct instances of a kind a pattern must have, and the worth at which it is used.
SUPPORT = 3
CONFIDENCE = 800_000
ONE = 1_000_000

# Same matches as the plain patterns, but each run of characters is tried once from its start.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.array_remove(F.split(F.reverse(_digits(value)), ""), "")
    doubled = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) < 3
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")
        return F.forall(F.split(value, r"\."), lambda p: part(p) | small(p))
    if kind == "card":
        count = F.length(_digits(value))
        return F.when((count >= 13) & (count <= 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _patterns(text: Column) -> dict:
    digit = F.rlike(text, F.lit("[0-9]"))
    return {
        "email": (_EMAIL, 0, F.contains(text, F.lit("@"))),
        "ip": (_IP, 0, digit),
        "card": (_CARD, 0, digit),
        "phone": (_PHONE, 0, F.contains(text, F.lit("+"))),
        "token": (_TOKEN, 0, digit | F.contains(text, F.lit("@"))),
    }


def _kind_number(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _valid_spans(matches: DataFrame) -> DataFrame:
    good = F.lit(False)
    for kind in KINDS:
        good = F.when(F.col("kind") == kind, is_valid(kind, F.col("value"))).otherwise(good)
    return matches.where(F.coalesce(good, F.lit(False)))


def _candidates(matches: DataFrame, seeds: DataFrame) -> DataFrame:
    """Words with a digit or at sign that overlap no seed."""
    both = seeds.select("key", "kind", "start", "end", "value", "left", "right").unionByName(matches.where("kind = 'token'"))
    seed_end = F.when(F.col("kind") != "token", F.col("end"))
    seed_start = F.when(F.col("kind") != "token", F.col("start"))
    in_order = Window.partitionBy("key").orderBy("start", "end", "kind")
    before = F.max(seed_end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(seed_start, ignorenulls=True).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    marked = both.withColumns({"before": before, "after": after})
    return marked.where("kind = 'token' AND coalesce(before, 0) <= start AND coalesce(after, end) >= end").drop("before", "after")


def _mentions(spans: DataFrame) -> DataFrame:
    """Spans with ``inst`` and the hashes of their lexical patterns ``pats``."""
    clean = lambda text: F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    left = F.array_remove(F.split(clean("left"), r"[\x20\x09-\x0D]+"), "")
    right = F.array_remove(F.split(clean("right"), r"[\x20\x09-\x0D]+"), "")
    shape = (
        F.when(F.contains("value", F.lit("@")), "at")
        .when(F.rlike("value", F.lit(r"\p{L}")), "mixed")
        .otherwise("digits")
    )
    worded = spans.withColumns({"l": left, "r": right, "shape": shape})
    one, two, after = F.try_element_at("l", F.lit(-1)), F.try_element_at("l", F.lit(-2)), F.get("r", 0)
    patterns = F.array_compact(
        F.array(
            F.when(one.isNotNull(), F.xxhash64(F.lit("L1"), one, "shape")),
            F.when(two.isNotNull(), F.xxhash64(F.lit("L2"), two, one, "shape")),
            F.when(one.isNotNull() & after.isNotNull(), F.xxhash64(F.lit("LR"), one, after, "shape")),
        )
    )
    return worded.select("key", "kind", "start", "end", F.xxhash64(F.lower("value")).alias("inst"), patterns.alias("pats"))


def _bootstrap(mentions: DataFrame, scratch: Scratch, rounds: int, support: int, confidence: int) -> DataFrame:
    """Mentions of candidates that good patterns extract: ``key``, ``kind``, ``start``, ``end``."""
    mentions = scratch.store(mentions, "mentions")
    edges = scratch.store(mentions.select("inst", F.explode("pats").alias("pat")).distinct(), "edges")
    degree = edges.groupBy("pat").agg(F.count("*").alias("degree"))
    seeds = mentions.where("kind <> 'token'").select("inst", "kind", F.lit(ONE).cast("long").alias("worth")).distinct()
    seeded = seeds.select("inst").distinct()
    worth = seeds
    good = None
    for _ in range(rounds):
        scored = (
            edges.join(worth, "inst")
            .groupBy("pat", "kind")
            .agg(F.sum("worth").alias("total"), F.count("*").alias("backed"))
            .where(F.col("backed") >= support)
            .join(degree, "pat")
            .select("pat", "kind", F.floor(F.col("total") / F.col("degree")).cast("long").alias("trust"))
            .where(F.col("trust") >= confidence)
        )
        good = scratch.store(scored, "patterns")
        spread = (
            edges.join(good, "pat")
            .join(seeded, "inst", "left_anti")
            .groupBy("inst", "kind")
            .agg(F.floor(F.sum("trust") / F.count("*")).cast("long").alias("worth"))
        )
        worth = scratch.store(seeds.unionByName(spread), "worth")
    accepted = worth.where(F.col("worth") >= confidence).select("inst", "kind")
    return (
        mentions.where("kind = 'token'")
        .drop("kind")
        .withColumn("pat", F.explode("pats"))
        .join(good.select("pat", "kind"), "pat")
        .join(accepted, ["inst", "kind"])
        .groupBy("key", "start", "end")
        .agg(F.min_by("kind", _kind_number(F.col("kind"))).alias("kind"))
        .select("key", "kind", "start", "end")
    )


def find_pii(
    docs: DataFrame, text_column: str = "text", scratch: Scratch | None = None, rounds: int = ROUNDS,
    support: int = SUPPORT, confidence: int = CONFIDENCE,
) -> tuple[DataFrame, DataFrame]:
    """Spans of the distinct texts of ``docs``: those of the patterns and those discovered.

    Both have ``key`` (``text_key`` of the text), ``kind``, ``start`` and ``end`` in code
    points. Discovered spans overlap no pattern's span.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    text = F.coalesce(named(text_column), F.lit(""))
    rows = docs.select(text_key(named(text_column)).alias("key"), text.alias("text"))
    matches = scratch.store(located(rows, _patterns(F.col("text"))), "matches")
    seeds = _valid_spans(matches)
    mentions = _mentions(seeds.unionByName(_candidates(matches, seeds)))
    found = scratch.store(_bootstrap(mentions, scratch, rounds, support, confidence), "found")
    return seeds.select("key", "kind", "start", "end"), found


def extract_pii(
    docs: DataFrame, text_column: str = "text", scratch: Scratch | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, or all) with counts, ``base_sha256`` and ``spans``.

    ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` count the patterns' spans and
    ``base_sha256`` digests them; ``spans`` lists them and the discovered ones. A null text
    counts as empty: no spans. Repeated rows get the same answer; input columns named like a
    result are replaced; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    base, found = find_pii(docs, text_column, scratch)
    order = F.struct(_kind_number(F.col("kind")), F.col("start"), F.col("end"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    of_base = listed(base, order, "base").join(base.groupBy("key").agg(*counts), "key")
    of_all = of_base.join(listed(base.unionByName(found), order, "spans"), "key", "full_outer")
    # Written, so that the join with the rows can split a text that very many rows have.
    of_all = scratch.store(of_all, "texts")
    names = keep or docs.columns
    rows = packed(docs.select(*[named(c) for c in dict.fromkeys([*names, text_column])]), key=text_key(named(text_column)))
    rows = rows.select(F.struct(*[named(c, "_row").alias(c) for c in names]).alias("_row"), "key")
    zero = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0).cast("long")) for k in KINDS}
    joined = rows.join(of_all, "key", "left").withColumns(
        zero | {"base_sha256": F.sha2(F.coalesce("base", F.lit("")), 256), "spans": F.coalesce("spans", F.lit(""))}
    )
    return unpacked(joined, names, [*zero, "base_sha256", "spans"])


def _replaced(kind: str, pattern: str) -> Column:
    gaps, matches = F.split("_text", pattern, -1), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    shown = lambda m: F.when(m.isNull(), "").when(is_valid(kind, m), f"<{kind.upper()}>").otherwise(m)
    return F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(g, shown(m))), "")


def redact_pii(docs: DataFrame, text_column: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind, as ``<EMAIL>``.

    Discovered spans are replaced at their places, then each pattern's valid matches, kind by
    kind, by splitting and joining the text. Null texts stay null; all columns stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    _, found = find_pii(docs, text_column, scratch)
    per_text = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_cuts"))
    per_text = scratch.store(per_text, "cuts")
    rows = packed(docs, _text=text_column, key=text_key(named(text_column)))
    joined = rows.join(per_text, "key", "left")
    before = lambda i: F.coalesce(F.get(F.col("_cuts"), i - 1)["end"], F.lit(0))
    pieces = F.transform(
        "_cuts",
        lambda c, i: F.concat(
            F.substring("_text", before(i) + 1, c["start"] - before(i)), F.lit("<"), F.upper(c["kind"]), F.lit(">")
        ),
    )
    last = F.element_at("_cuts", -1)["end"]
    text = F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(
        F.concat(F.array_join(pieces, ""), F.substring("_text", last + 1, F.length("_text")))
    )
    joined = joined.withColumn("_text", text)
    patterns = _patterns(F.col("_text"))
    for kind in KINDS:
        pattern, _, needed = patterns[kind]
        joined = joined.withColumn("_text", F.when(needed, _replaced(kind, pattern)).otherwise(F.col("_text")))
    return settled(joined.select("_row", "_text")).select(
        *[(F.col("_text") if c == text_column else named(c, "_row")).alias(c) for c in docs.columns]
    )
