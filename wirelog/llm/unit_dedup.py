"""Substring deduplication by hashing lines, cut further at sentence ends.

A passage that is pasted into the middle of a line has no line of its own, so the unit is by
default a line's sentence (``unit="line"`` and ``unit="paragraph"`` keep whole lines, or blocks
between blank lines). Units are lower-cased, their white space and ASCII punctuation removed, and
hashed to 128 bits. Over all documents the occurrence with the least (doc_id, text_key, start) stays,
where ``text_key`` tells texts of one id apart; later ones are removable. Removable units that follow each other form a passage; all are
removed, unless ``min_words`` asks for longer ones only. A passage that was pasted after
unfinished text, or before some, shares a unit with it: ``whole_passages`` lets each passage grow
over the words at its two ends that its first occurrence has there too. Every unit carries a hash of
the words beside it on either side, so texts are read again only where these agree.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelog.llm.frames import Scratch, named, packed

MIN_WORDS = 1
#: Words of a partial unit that must agree: fewer are the like beginnings of different sentences.
EDGE_WORDS = 3
_UNITS_PER_BATCH = 20_000

_UNITS = {
    "sentence": re.compile(r"[^\n.!?]*(?:[.!?]+(?![\s.!?])[^\n.!?]*)*(?:[.!?]+|\n|\Z)"),
    "line": re.compile(r"[^\n]*(?:\n|\Z)"),
    "paragraph": re.compile(r"(?:[^\n]+(?:\n|\Z))+|\n+"),
}
_PUNCTUATION = dict.fromkeys(range(0x21, 0x30)) | dict.fromkeys(range(0x3A, 0x41))
_PUNCTUATION |= dict.fromkeys(range(0x5B, 0x61)) | dict.fromkeys(range(0x7B, 0x7F))


#: White space beyond ASCII, and what ASCII has of it that bytes don't split at.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACES = bytes(0x20 if 0x1C <= b <= 0x1F else b for b in range(256))
_DELETED = bytes(_PUNCTUATION)


def worded_units(text: str, unit: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """Start, end and words, in UTF-8, of each unit that has a letter or digit."""
    wide = _WIDE_SPACE.search(text)
    for found in _UNITS[unit].finditer(text):
        lower = found.group().lower()
        if wide:
            words = [word.encode() for word in lower.translate(_PUNCTUATION).split()]
        else:
            words = lower.encode().translate(_SPACES, _DELETED).split()
        if words:
            yield found.start(), found.end(), words


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def units_of(text: str, unit: str) -> Iterator[tuple[int, int, int, bytes]]:
    """Start, end, number of words and digest of each unit."""
    for start, end, words in worded_units(text, unit):
        yield start, end, len(words), digest_of(words)


def _cutter(unit: str, edge_words: int):
    """Units of texts; ``before`` and ``after`` are hashes of the ``edge_words`` words next to one, in its neighbours."""
    names = ["doc_id", "text_key", "unit", "start", "end", "words", "digest", "before", "after"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def edge(words: list[bytes]) -> int | None:
        if len(words) < edge_words:
            return None
        return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)

    def flushed(batch: pa.RecordBatch, rows: list, units: list) -> pa.RecordBatch:
        own = pa.array(rows, pa.int64())
        columns = [pa.array(values, kind) for values, kind in zip(zip(*units), kinds)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("text_key").take(own), *columns], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, units = batch.column("text"), [], []
            for row in range(batch.num_rows):
                found = list(worded_units(texts[row].as_py(), unit))
                firsts = [edge(words[:edge_words]) for _, _, words in found] + [None]
                lasts = [None] + [edge(words[-edge_words:]) for _, _, words in found]
                for number, (start, end, words) in enumerate(found):
                    rows.append(row)
                    units.append((number, start, end, len(words), digest_of(words), lasts[number], firsts[number + 1]))
                if len(rows) > _UNITS_PER_BATCH or (rows and row + 1 == batch.num_rows):
                    yield flushed(batch, rows, units)
                    rows, units = [], []

    return cut


def repeated_passages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    unit: str = "sentence",
    min_words: int = MIN_WORDS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per removed passage: where it lies and which document keeps its first unit.

    ``doc_id``, ``start`` and ``end`` (code points, end exclusive), ``n_units``, ``n_words``,
    ``kept_doc_id``, ``kept_start`` and, of the text that is cut, ``text_key``. Rows without id have no rank:
    they are left whole and nothing is removed on their account. Rows that repeat an id and text are one
    document; different texts of one id are documents of their own. Null and empty texts have no units; an empty table gives an empty result; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "unit-dedup")
    return _told(_passages(_texts(docs, id_column, text_column), unit, min_words, EDGE_WORDS, scratch))


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = named(text_column)
    return docs.select(named(id_column).alias("doc_id"), _text_key(text).alias("text_key"), text.alias("text")).where(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )


def _told(passages: DataFrame) -> DataFrame:
    return passages.select(
        "doc_id", "start", "end", "n_units", "n_words",
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), "text_key",
    )


def _passages(rows: DataFrame, unit: str, min_words: int, edge_words: int, scratch: Scratch) -> DataFrame:
    """The passages; ``kept`` and ``kept_last`` are the first occurrences of their first and last unit.

    ``grows_left`` and ``grows_right``: the words beside the passage and beside these agree, as far as hashes tell.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    units = rows.mapInArrow(
        _cutter(unit, edge_words),
        f"doc_id {kind}, text_key bigint, unit int, start bigint, end bigint, words int, digest binary, "
        "before bigint, after bigint",
    )
    seen = F.struct("doc_id", "text_key", "start", "end", "before", "after")
    # Written, so that the join below shuffles both sides anew and can split a common unit.
    first = scratch.store(
        units.groupBy("digest")
        .agg(F.min(seen).alias("kept"), F.max(seen).alias("last"))
        .where("kept <> last")
        .select("digest", "kept"),
        "repeated",
    )
    scratch.tidy()
    here = F.struct("doc_id", "text_key", "start")
    removable = (
        units.join(first, "digest")
        .where(here != F.struct("kept.doc_id", "kept.text_key", "kept.start"))
        .select("doc_id", "text_key", "unit", "start", "end", "words", "kept", "before", "after")
        .distinct()
    )
    place = Window.partitionBy("doc_id", "text_key").orderBy("unit")
    runs = removable.withColumn("run", F.col("unit") - F.dense_rank().over(place))
    return (
        runs.groupBy("doc_id", "text_key", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count("*").alias("n_units"),
            F.sum("words").alias("n_words"),
            F.min_by("kept", "unit").alias("kept"),
            F.max_by("kept", "unit").alias("kept_last"),
            F.coalesce(F.min_by(F.col("before") == F.col("kept.before"), "unit"), F.lit(False)).alias("grows_left"),
            F.coalesce(F.max_by(F.col("after") == F.col("kept.after"), "unit"), F.lit(False)).alias("grows_right"),
        )
        .where(F.col("n_words") >= min_words)
    )


_WORD = re.compile(r"\S+")


def _side_words(unit: str):
    """Per wanted place the words beside it, nearest first, up to the end of their unit."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            texts, wanted = batch.column("text"), batch.column("wanted")
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                spans = [(start, end) for start, end, _, _ in units_of(text, unit)]
                starts, ends = [s[0] for s in spans], [s[1] for s in spans]
                places, lefts, hashes, reaches = [], [], [], []
                for place, left in sorted((w["place"], w["left"]) for w in wanted[row].as_py()):
                    at = bisect_right(ends, place) - 1 if left else bisect_left(starts, place)
                    words = []
                    if 0 <= at < len(spans):
                        for found in _WORD.finditer(text, *spans[at]):
                            word = found.group().lower().translate(_PUNCTUATION)
                            if word:
                                value = xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)
                                words.append((value, found.start() if left else found.end()))
                    places.append(place)
                    lefts.append(left)
                    words = words[::-1] if left else words
                    hashes.append([w[0] for w in words])
                    reaches.append([w[1] for w in words])
                if places:
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([row] * len(places), pa.int64())),
                            keys.take(pa.array([row] * len(places), pa.int64())),
                            pa.array(places, pa.int64()),
                            pa.array(lefts, pa.bool_()),
                            pa.array(hashes, pa.list_(pa.int64())),
                            pa.array(reaches, pa.list_(pa.int64())),
                        ],
                        names=["doc_id", "text_key", "place", "left", "words", "reach"],
                    )

    return sides


def whole_passages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    unit: str = "sentence",
    min_words: int = MIN_WORDS,
    edge_words: int = EDGE_WORDS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``repeated_passages``, each grown over what it repeats of the units at its two ends.

    A side grows by the words, ``edge_words`` or more, that stand there and beside the first
    occurrence alike, at most to the end of the unit. ``n_words`` counts them; passages that
    meet share no word.
    """
    scratch = scratch or Scratch(docs.sparkSession, "unit-dedup")
    rows = _texts(docs, id_column, text_column)
    runs = scratch.store(_passages(rows, unit, min_words, edge_words, scratch), "passages")
    scratch.tidy()
    sides = {
        "l": (F.col("grows_left"), True, ("", "start"), ("kept.", "kept.start")),
        "r": (F.col("grows_right"), False, ("", "end"), ("kept_last.", "kept_last.end")),
    }
    wanted = None
    for grows, left, *both in sides.values():
        for of, place in both:
            some = runs.where(grows).select(
                F.col(f"{of}doc_id").alias("doc_id"), F.col(f"{of}text_key").alias("text_key"),
                F.col(place).alias("place"), F.lit(left).alias("left"),
            )
            wanted = some if wanted is None else wanted.union(some)
    wanted = wanted.distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("place", "left")).alias("wanted"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    beside = rows.join(wanted, ["doc_id", "text_key"]).mapInArrow(
        _side_words(unit),
        f"doc_id {kind}, text_key bigint, place bigint, left boolean, words array<bigint>, reach array<bigint>",
    )
    # Rows that repeat an id and text are one document. Written, so that the joins can split a common first occurrence.
    beside = scratch.store(beside.dropDuplicates(["doc_id", "text_key", "place", "left"]), "sides")
    scratch.tidy()
    for name, (_, left, (_, place), (of, kept_place)) in sides.items():
        side = beside.where(F.col("left") == left)
        mine = side.select("doc_id", "text_key", F.col("place").alias(place), F.col("words").alias(f"{name}_words"), F.col("reach").alias(f"{name}_reach"))
        theirs = side.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_key", "place", "words")])
        runs = runs.join(mine, ["doc_id", "text_key", place], "left")
        there = (F.col(f"{of}doc_id") == F.col("_doc_id")) & (F.col(f"{of}text_key") == F.col("_text_key"))
        runs = runs.join(theirs, there & (F.col(kept_place) == F.col("_place")), "left")
        differ = F.zip_with(f"{name}_words", "_words", lambda a, b: ~a.eqNullSafe(b))
        at = F.array_position(differ, True)
        common = F.coalesce(F.when(at == 0, F.size(differ)).otherwise(at - 1), F.lit(0))
        runs = runs.withColumn(f"{name}_more", F.when(common >= edge_words, common).otherwise(0).cast("int"))
        runs = runs.drop("_doc_id", "_text_key", "_place", "_words")
    grown = runs.select(
        "doc_id", "text_key", "n_units", "n_words", "kept", "l_more", "r_more", F.size("l_words").alias("l_size"), F.col("start").alias("was"),
        F.when(F.col("l_more") > 0, F.element_at("l_reach", F.greatest("l_more", F.lit(1)))).otherwise(F.col("start")).alias("start"),
        F.when(F.col("r_more") > 0, F.element_at("r_reach", F.greatest("r_more", F.lit(1)))).otherwise(F.col("end")).alias("end"),
    )
    in_order = Window.partitionBy("doc_id", "text_key").orderBy("was")
    meet = F.coalesce(F.lag("end").over(in_order) > F.col("start"), F.lit(False))
    placed = grown.withColumns(
        {"meet": meet, "last_end": F.lag("end").over(in_order), "last_more": F.lag("r_more").over(in_order)}
    )
    return _told(
        placed.withColumns(
            {
                "start": F.when(F.col("meet"), F.col("last_end")).otherwise(F.col("start")),
                "n_words": F.col("n_words") + F.col("r_more")
                + F.when(F.col("meet"), F.col("l_size") - F.col("last_more")).otherwise(F.col("l_more")),
            }
        )
    )


def remove_passages(
    docs: DataFrame, passages: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with the passages cut out of the text and their offsets in ``removed_spans``.

    ``removed_spans`` lists ``start:end`` in the original text, comma-joined, or is empty. Rows that
    repeat an id and text are cut alike; another text of the id has passages of its own.
    """
    spans = passages.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    rows = packed(docs, id=id_column, text=text_column, key=_text_key(named(text_column)))
    same = (rows.id == spans.doc_id) & (rows.key == spans.text_key)
    joined = rows.join(spans, same, "left").select("_row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                kept, at = [], 0
                for span in found or ():
                    kept.append(text[at : span["start"]])
                    at = span["end"]
                texts.append(text if text is None else "".join(kept) + text[at:])
                names.append(",".join(f"{s['start']}:{s['end']}" for s in found or ()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(texts, pa.string()), pa.array(names, pa.string())],
                names=["_row", "text", "removed_spans"],
            )

    done = joined.mapInArrow(cut, joined.select("_row", "text").schema.add("removed_spans", "string"))
    kept = [(F.col("text") if c == text_column else named(c, "_row")).alias(c) for c in docs.columns if c != "removed_spans"]
    return done.select(*kept, "removed_spans")
