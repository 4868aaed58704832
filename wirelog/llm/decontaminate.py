"""Benchmark decontamination with spaced seeds.

Words are compared in lower case without ASCII punctuation. Each mask selects some places of a
short window and ignores the others, so a replaced word at an ignored place does not hide the
window. Masked windows of benchmark items are indexed; every masked window of every document
is looked up, and at each hit both texts are laid side by side. They leak when any stretch of at
least ``min_tokens`` words (or the whole item, if shorter) differs in at most a share of
``max_substituted``. With the default limits every such stretch of 13 words or more holds a
window of one of ``MASKS``, so none is missed. Items under 13 words have masks of their own length:
cut into two parts more than words may differ, two parts at least are clean. Items under five
words must be met word by word.

The items are dealt by hash into blocks of about ``BLOCK_TOKENS`` words. One block at a time
is sent to the tasks, so what a task holds is bounded however large the benchmarks are; the
documents are never shuffled and pass each block once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelog.llm.frames import named, packed, unpacked
from wirelog.llm.hashing import mix, pieces, word_hashes

#: Four masks of eight words, and five of six that hit every stretch of 13 words or more of which
#: a fifth at most differs: three parts of 13 words, two parts of 15 or the first six are clean.
MASKS = (
    "111101111", "11011011011", "111001001111", "101110011101",
    "111111", "111000111", "111000000111", "111000000000111", "1111101",
)
MIN_TOKENS = 13
MAX_SUBSTITUTED = 0.2
BLOCK_TOKENS = 1 << 18
_TABLE_BITS = 22
_LANES = mix(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Block:
    """Benchmark items of a block and the index of their masked windows."""

    items: list
    tokens: np.ndarray
    starts: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    table: np.ndarray
    min_tokens: int
    max_substituted: float


def normalised(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[!-/:-@\[-`{-~]+", "")


def seed_hashes(tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One hash per window start: the words at the selected places."""
    count = len(tokens) - int(places[-1])
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, np.uint64(len(places)) * np.uint64(1 << 32) + np.uint64(int((1 << places).sum())), np.uint64)
    for lane, place in enumerate(places.tolist()):
        total += tokens[place : place + count] * _LANES[lane]
    return mix(total)


def short_masks(count: int, max_substituted: float) -> list[np.ndarray]:
    """Places of an item of ``count`` words; one set at least is clean when few enough words differ."""
    differ = int(max_substituted * count + 1e-9)
    parts = np.array_split(np.arange(count), differ + 2)
    chosen = {tuple(np.concatenate(pair).tolist()) for pair in combinations(parts, 2)}
    return [np.array(places) for places in sorted(chosen) if places]


def build_block(items: list, texts: list, min_tokens: int, max_substituted: float) -> Block:
    tokens, starts = word_hashes(normalised(pa.array(texts, pa.large_string())))
    lengths = np.diff(starts)
    masks = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in MASKS]
    table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    seeds = []
    of_short = [
        (places, lengths == n, 1)
        for n in sorted({int(n) for n in lengths if 0 < n < MIN_TOKENS})
        for places in short_masks(n, max_substituted)
    ]
    for places, chosen, windows in [(m, lengths >= min(min_tokens, MIN_TOKENS), None) for m in masks] + of_short:
        hashes, at = [], []
        for item in np.flatnonzero(chosen):
            found = seed_hashes(tokens[starts[item] : starts[item + 1]], places)[:windows]
            hashes.append(found)
            at.append(starts[item] + np.arange(len(found)))
        if hashes:
            h, p = np.concatenate(hashes), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            seeds.append((places, h[order], p[order]))
            table[h >> np.uint64(64 - _TABLE_BITS)] = True
    return Block(items, tokens, starts, seeds, table, min_tokens, max_substituted)


def best_stretch(same: np.ndarray, least: int, max_substituted: float) -> tuple[int, int, int] | None:
    """Start, end and matches of the stretch of most matches, the shortest, then earliest of equals.

    Of all stretches of ``same`` of at least ``least`` words of which at most a share of
    ``max_substituted`` differs; the longest of them has the most matches.
    """
    count = len(same)
    if count < least:
        return None
    matches = np.concatenate([[0], np.cumsum(same)])
    places = np.arange(count + 1)
    # a stretch i:j qualifies when slack[j] >= slack[i]
    slack = np.round(max_substituted * places - (places - matches), 9)
    highest = np.maximum.accumulate(slack[::-1])[::-1]
    ends = np.searchsorted(-highest, -slack, side="right") - 1
    begin = int((ends - places).argmax())
    end = int(ends[begin])
    if end - begin < least:
        return None
    matched = int(matches[end] - matches[begin])
    if not matched:
        return None
    where = np.flatnonzero(same)
    sizes = np.maximum(where[matched - 1 :] - where[: len(where) - matched + 1] + 1, least)
    first = int(sizes.argmin())
    begin = min(int(where[first]), count - int(sizes[first]))
    return begin, begin + int(sizes[first]), matched


def overlaps(texts: pa.Array, block: Block) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, first word, last word + 1, matches): the best stretch of each text and item."""
    for base, part in pieces(normalised(texts)):
        tokens, starts = word_hashes(part)
        text_of = np.repeat(np.arange(len(part)), np.diff(starts))
        pairs = [np.empty((3, 0), np.int64)]
        for places, hashes, at in block.seeds:
            mine = seed_hashes(tokens, places)
            hits = np.flatnonzero(block.table[mine >> np.uint64(64 - _TABLE_BITS)])
            hits = hits[text_of[hits] == text_of[hits + int(places[-1])]]
            first = np.searchsorted(hashes, mine[hits])
            counts = np.searchsorted(hashes, mine[hits], side="right") - first
            hits, first, counts = hits[counts > 0], first[counts > 0], counts[counts > 0]
            begin = np.repeat(first - np.cumsum(counts) + counts, counts)
            where, spots = np.repeat(hits, counts), at[begin + np.arange(len(begin))]
            text, item = text_of[where], np.searchsorted(block.starts, spots, side="right") - 1
            shifts = (where - starts[text]) - (spots - block.starts[item])
            pairs.append(np.unique(np.stack([text, item, shifts]), axis=1))
        every = np.unique(np.concatenate(pairs, axis=1), axis=1)
        # items shorter than a stretch must fit whole: all of a length are judged at once
        lengths = np.diff(block.starts)[every[1]]
        alone = lengths < block.min_tokens
        best: dict = {}
        for count in np.unique(lengths[alone]).tolist():
            text, item, shift = every[:, alone & (lengths == count)]
            fits = (shift >= 0) & (shift + count <= np.diff(starts)[text])
            text, item, shift = text[fits], item[fits], shift[fits]
            matched = np.zeros(len(text), np.int64)
            for word in range(count):
                matched += tokens[starts[text] + shift + word] == block.tokens[block.starts[item] + word]
            good = np.flatnonzero(count - matched <= block.max_substituted * count + 1e-9)
            good = good[np.lexsort((shift[good], -matched[good], item[good], text[good]))]
            _, first = np.unique(np.stack([text[good], item[good]]), axis=1, return_index=True)
            for k in good[first].tolist():
                best[int(text[k]), int(item[k])] = (-int(matched[k]), int(shift[k]), int(shift[k]) + count)
        for text, item, shift in every[:, ~alone].T.tolist():
            doc = tokens[starts[text] : starts[text + 1]]
            words = block.tokens[block.starts[item] : block.starts[item + 1]]
            low, high = max(0, -shift), min(len(words), len(doc) - shift)
            stretch = best_stretch(
                doc[low + shift : high + shift] == words[low:high],
                min(block.min_tokens, len(words)),
                block.max_substituted,
            )
            if stretch is None:
                continue
            begin, end, matched = stretch
            found = (-matched, begin + low + shift, end + low + shift)
            if found < best.get((text, item), (1,)):
                best[text, item] = found
        for (text, item), (matched, begin, end) in sorted(best.items()):
            yield base + text, item, begin, end, -matched


def _blocks(items: DataFrame, item_column: str, text_column: str, min_tokens: int, max_substituted: float):
    """The benchmark, block by block; texts are cut no smaller than an item."""
    rows = items.select(named(item_column).alias("item"), named(text_column).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-size // (4 * BLOCK_TOKENS)))
    dealt = rows.distinct().withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)))
    for number in range(count):
        held = dealt.where(F.col("block") == number).orderBy("item", "text").toArrow()
        if held.num_rows:
            yield build_block(
                held.column("item").to_pylist(), held.column("text").to_pylist(), min_tokens, max_substituted
            )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    min_tokens: int = MIN_TOKENS,
    max_substituted: float = MAX_SUBSTITUTED,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``first_token``, ``end_token``, ``matched`` per leak.

    One row per document and item, with the stretch of most matches (the earliest of equals);
    places count words of the document that have a letter or digit. Null and empty texts and
    items leak nothing; repeated rows repeat their leaks; two items with one id are two items;
    an empty table on either side gives an empty result; other columns are not read.
    """
    rows = docs.select(named(id_column).alias("doc_id"), named(text_column).cast("string").alias("text"))
    item_type = benchmark.select(named(item_column)).schema[0].dataType.simpleString()
    schema = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, "
        "first_token bigint, end_token bigint, matched bigint"
    )
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, item_column, "text", min_tokens, max_substituted):
        found = found.unionByName(rows.mapInArrow(_reporter(block, found.schema), schema))
    return found


def _reporter(block: Block, schema):
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(schema["item_id"].dataType)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(overlaps(batch.column("text"), block))
            at = pa.array([f[0] for f in found], pa.int64())
            columns = [batch.column("doc_id").take(at), pa.array([block.items[f[1]] for f in found], item_type)]
            columns += [pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "item_id", "first_token", "end_token", "matched"]
            )

    return report


def drop_leaking(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    min_tokens: int = MIN_TOKENS,
    max_substituted: float = MAX_SUBSTITUTED,
) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text holds no benchmark stretch."""
    kept = packed(docs, text=named(text_column).cast("string"))
    schema = kept.schema
    for block in _blocks(benchmark, item_column, "text", min_tokens, max_substituted):
        kept = kept.mapInArrow(_filter(block), schema)
    return unpacked(kept, docs.columns)


def _filter(block: Block):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for found in overlaps(batch.column("text"), block):
                clean[found[0]] = False
            yield batch.filter(pa.array(clean))

    return keep
