"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures.

A word is the multiset of its letters, a binary vector with one place per (letter, occurrence).
One inserted or deleted letter changes one place, one replaced letter two, so words that are one
edit apart differ in at most two places. Letters are dealt into parts; of ``p`` parts at least
``p - d`` hold the same letters in two vectors ``d`` places apart, so every choice of ``p - d``
parts is a signature and words that are near share one exactly. An edit also leaves the first
or the second half of a word alone, and that half is part of the signature. Signatures
meet in an equi-join; the edit distance of each pair is then computed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.llm.frames import Scratch, named

#: Letters of words; only A to Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
SHORTEST = 5
RAREST = 3
#: Parts of the letters where one letter is replaced (two places differ, so two parts of four
#: agree) and where one is inserted (one place differs, so two of three agree).
PARTS_REPLACED, PARTS_INSERTED = 4, 3
#: The usual letters by frequency, then all others by code point: dealt in turn to the parts.
_ORDER = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct words that a task holds before it hands its counts on.
_HELD = 1 << 18


def _counter(slip: int | None):
    runs, lower = re.compile(LETTERS), str.maketrans(_UPPER, _LOWER)

    def flushed(counts: dict) -> pa.RecordBatch:
        names = ["word", "n"]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=names
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(runs.findall(text)).items():
                    word = run.lower() if run.isascii() else run.translate(lower)
                    if slip:
                        mark = zlib.crc32(word.encode(), start)
                        if mark % slip == 0:
                            at = mark % len(word)
                            word = word[:at] + word[at + 1 :]
                    held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield flushed(held)
                    held = {}
        yield flushed(held)

    return count


def count_words(
    docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", slip: int | None = None,
    shortest: int = SHORTEST, rarest: int = RAREST,
) -> DataFrame:
    """``word`` and its occurrences ``n`` in all texts, from ``shortest`` letters and ``rarest`` occurrences on.

    With ``slip`` one letter is left out of every word whose checksum with its document's id
    (null: the empty string) that number divides: known misspellings, to measure with. Null texts
    have no words; repeated rows count each. Counts are added up in the tasks first.
    """
    texts = docs.select(
        F.coalesce(named(id_column).cast("string"), F.lit("")).alias("key"), named(text_column).alias("text")
    ).where("text is not null")
    counted = texts.mapInArrow(_counter(slip), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.char_length("word") >= shortest) & (F.col("n") >= rarest))


def _merged(table: DataFrame) -> DataFrame:
    """``table``, as the right side of a join that sorts both.

    Spark sizes a table of words by its compressed files, and does not count the rows that an
    explode adds: left to choose, it would broadcast millions of rows as a few megabytes.
    """
    return table.hint("merge")


def _dealt(words: DataFrame) -> DataFrame:
    """The letters of each word, sorted and cut into parts: arrays ``replaced`` and ``inserted``."""

    def parts(count: int) -> Column:
        gone = ["".join(c for i, c in enumerate(_ORDER) if i % count != part) for part in range(count)]
        return F.array(*[F.translate("letters", others, "") for others in gone])

    sorted_letters = F.array_join(F.sort_array(F.split("word", "")), "")
    return words.withColumn("letters", sorted_letters).select(
        "word", "n", parts(PARTS_REPLACED).alias("replaced"), parts(PARTS_INSERTED).alias("inserted")
    )


def _signed(dealt: DataFrame, name: str, less: int) -> DataFrame:
    """A row with a hash per word, half and choice of two parts.

    A pair's signature holds the length of its shorter word: a word is ``less`` letters over it
    where the pair differs by an inserted letter.
    """
    choices = [
        F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(first).alias("first"))
        for kind, count in (("replaced", PARTS_REPLACED), ("inserted", PARTS_INSERTED))
        for i, j in combinations(range(count), 2)
        for first in (True, False)
    ]
    replaced = F.col("choice.kind") == "replaced"
    shorter = F.char_length("word") - F.when(replaced, 0).otherwise(less)
    rows = dealt.withColumn("choice", F.explode(F.array(*choices))).select(
        "word", "n", "choice", F.when(replaced, F.col("replaced")).otherwise(F.col("inserted")).alias("parts"),
        shorter.alias("shorter"),
    )
    size = F.floor(F.col("shorter") / 2).cast("int")
    half = F.when(F.col("choice.first"), F.left("word", size)).otherwise(F.right("word", size))
    chosen = [F.col("parts")[F.col(f"choice.{at}")] for at in "ij"]
    return rows.select(
        F.col("word").alias(name),
        F.col("n").alias(f"{name}_n"),
        F.xxhash64("choice", "shorter", half, *chosen).alias("signature"),
    )


def near_words(words: DataFrame) -> DataFrame:
    """Every pair of ``words`` (``word``, ``n``) one edit apart, once: ``a``, ``a_n``, ``b``, ``b_n``.

    Words are distinct, made of a to z and the letters from U+00C0 to U+00FF.
    """
    dealt = _dealt(words)
    left, right = _signed(dealt, "a", 0), _signed(dealt, "b", 1)
    met = left.join(_merged(right), "signature").where(
        (F.char_length("a") + 1 == F.char_length("b"))
        | ((F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b")))
    )
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word.

    The form of a word is the most frequent word near it (ties: the first in code-point order) if
    that is at least ``ratio`` times as frequent; forms are followed to the root by doubling
    steps, a join each, and chains are short because frequencies at least double.
    """
    if ratio < 2:
        raise ValueError(f"forms must be at least twice as frequent, not {ratio} times")
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.store(words.select("word", "n"), "words")
    both_ways = [
        F.struct(F.col(x).alias("word"), (-F.col(f"{y}_n")).alias("less"), F.col(y).alias("near"))
        for x, y in (("a", "b"), ("b", "a"))
    ]
    best = (
        near_words(words)
        .select(F.explode(F.array(*both_ways)).alias("link"))
        .groupBy("link.word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct("link.less", "link.near")).alias("best"))
    )
    frequent = -F.col("best.less") >= ratio * F.col("n")
    rated = scratch.store(
        words.join(_merged(best), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, F.col("best.near")).alias("form"),
            F.when(frequent, -F.col("best.less")).alias("form_n"),
        ),
        "rated",
    )
    steps = scratch.store(rated.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = scratch.store(
            steps.join(_merged(onward), "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "steps",
        )
        scratch.drop(steps)
        steps = further.select("word", "root")
        steps._scratch_path = further._scratch_path
        if further.where("moved").isEmpty():
            break
    return rated.join(_merged(steps), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", slip: int | None = None
) -> DataFrame:
    """The words of ``docs`` (see ``count_words``) with their forms and roots; no texts, no rows."""
    return group_variants(count_words(docs, text_column, id_column, slip))
