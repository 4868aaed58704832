"""Pattern matches with their places, by SQL expressions alone.

A text is split by a pattern and its matches are extracted; gaps and matches in turn make up
the text. Their lengths are summed by a window over the matches of one text, so a text of very many
matches costs no more than sorting them. Texts are told apart by ``text_key``: a text that
occurs often is worked on once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pieces_of(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (place, gap length, match length, value, left, right) in order."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.filter(
        F.transform(
            F.arrays_zip(gaps.alias("gap"), whole.alias("match"), values.alias("value"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after")),
            lambda p, i: F.struct(
                i.alias("place"),
                F.length(p["gap"]).alias("gap"),
                F.length(p["match"]).alias("length"),
                p["value"].alias("value"),
                F.right(p["gap"], F.lit(CONTEXT)).alias("left"),
                F.left(p["after"], F.lit(CONTEXT)).alias("right"),
            ),
        ),
        lambda p: p["length"].isNotNull(),
    )


#: Characters of context kept on each side of a match.
CONTEXT = 80


def located(rows: DataFrame, patterns: dict[str, tuple[str, int, Column]]) -> DataFrame:
    """Matches of ``text`` in ``rows`` (``key``, ``text``): one row per distinct key and match.

    ``patterns`` maps a kind to pattern, group of the value and a condition without which a
    text need not be searched. ``key``, ``kind``, ``start``, ``end``, ``value``, ``left``, ``right``.
    """
    def of_kind(kind: str, pattern: str, group: int) -> Column:
        return F.transform(
            pieces_of(F.col("text"), pattern, group), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p"))
        )

    found = [F.when(needed, of_kind(kind, pattern, group)) for kind, (pattern, group, needed) in patterns.items()]
    empty = F.filter(F.transform(pieces_of(F.lit(""), "x"), lambda p: F.struct(F.lit("").alias("kind"), p.alias("p"))), lambda x: F.lit(False))
    every = F.concat(*[F.coalesce(f, empty) for f in found])
    matches = (
        rows.select("key", F.explode(every).alias("m"))
        .select("key", "m.kind", "m.p.*")
        .groupBy("key", "kind", "place", "gap", "length")
        .agg(F.first("value").alias("value"), F.first("left").alias("left"), F.first("right").alias("right"))
    )
    run = Window.partitionBy("key", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(run)
    return matches.select(
        "key", "kind", (end - F.col("length")).alias("start"), end.alias("end"), "value", "left", "right"
    )


def listed(spans: DataFrame, order: Column, name: str) -> DataFrame:
    """Per key the spans as ``kind:start:end``, joined by commas in ``order`` (a struct)."""
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    return spans.groupBy("key").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), label.alias("s")))), lambda x: x["s"]), ",").alias(name)
    )
