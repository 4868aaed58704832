"""Token counts by a public tokenizer; huge texts are encoded in overlapping chunks.

Chunks of a huge text overlap. Both encodings of an overlap carry offsets, and they are spliced
where they have the same tokens at the same places on both sides of a white-space character that
no token covers: the tokenizer never merges across white space, so the left chunk is right up
to there and the right chunk from there on. Where an overlap offers no such place it is
widened, in the end to the whole rest.

Other texts are counted word by word where the tokenizer drops white space before it merges (which
its file says): the count of a text is then the sum over its words, and a word that a task has
met is looked up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelog.llm.frames import named, packed, unpacked

LIMIT = 2048
CHUNK = 1 << 16
OVERLAP = 1 << 9
#: Tokens that must agree on each side of a splice.
AGREE = 4
_BATCH_CHARACTERS = 1 << 20
#: Characters that part words here; all of them are white space to every tokenizer.
_WORD = re.compile(r"[^ \t\n\r]+")
#: What a task remembers: so many words of so many characters at most, some 50 MB.
_KNOWN_WORDS, _KNOWN_LENGTH = 1 << 18, 48


def tokenizer(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def _offsets(encode, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    coded = encode(text[start:end], add_special_tokens=False)
    return [(i, a + start, b + start) for i, (a, b) in zip(coded.ids, coded.offsets)]


def splice_point(left: list, right: list, text: str, low: int, high: int) -> tuple[int, int] | None:
    """Counts of tokens to take from ``left`` and to leave out of ``right``, or nothing."""
    ends = {}
    for k in range(AGREE, len(right) - AGREE + 1):
        ends[right[k][1]] = k
    for j in range(len(left) - AGREE, AGREE - 1, -1):
        start = left[j][1]
        if start <= low:
            return None
        k = ends.get(start)
        if k is None or start > high or start <= left[j - 1][2] or not text[left[j - 1][2] : start].isspace():
            continue
        if left[j - AGREE : j + AGREE] == right[k - AGREE : k + AGREE]:
            return j, k
    return None


def count_long(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, encoded in chunks."""
    total, start, skip = 0, 0, 0
    end = min(len(text), chunk)
    left = _offsets(encode, text, start, end)
    while end < len(text):
        width = overlap
        while True:
            begin = max(start, end - width)
            stop = min(len(text), begin + chunk + width)
            right = _offsets(encode, text, begin, stop)
            found = splice_point(left[skip:], right, text, begin, end)
            if found or begin == start:
                break
            width *= 4
        if found:
            total += found[0]
            start, end, skip, left = begin, stop, found[1], right
        else:
            # no stable place in the whole chunk: encode it together with what follows
            end = min(len(text), end + chunk)
            left = _offsets(encode, text, start, end)
            chunk *= 2
    return total + len(left) - skip


def drops_space(path: str) -> bool:
    """Whether the file's rules split at white space and forget it, special strings included."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    normalizer, splitter = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    harmless = all(
        step["type"] in ("NFC", "Lowercase")
        or (step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " ")
        for step in steps
    )
    first, *others = splitter.get("pretokenizers", [splitter])
    pattern = first.get("pattern", {}).get("Regex", " ")
    matches_space = re.search(r"\\[sSWDPX]|[ .]", pattern.replace(r"[^\s", "["))
    parted = first.get("behavior") == "Removed" and first.get("invert") and not matches_space
    plain = all(step.get("type") == "ByteLevel" and not step.get("add_prefix_space") for step in others)
    added = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and _WORD.fullmatch(t["content"])
        for t in rules.get("added_tokens", [])
    )
    return bool(harmless and parted and plain and added and not rules.get("post_processor"))


class _Words:
    """Token counts of words, remembered up to a bound."""

    def __init__(self, loaded):
        self.loaded, self.known = loaded, {}

    def count(self, texts: list[str]) -> list[int]:
        words = [_WORD.findall(text) for text in texts]
        new = list(set().union(*words).difference(self.known))
        self.known.update(zip(new, map(len, self.loaded.encode_batch_fast(new, add_special_tokens=False))))
        totals = [sum(map(self.known.__getitem__, some)) for some in words]
        if len(self.known) > _KNOWN_WORDS:
            self.known = {}
        for word in new:
            if len(word) > _KNOWN_LENGTH:
                self.known.pop(word, None)
        return totals


def _counter(path: str, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        loaded = tokenizer(path)
        if drops_space(path):
            counted = _Words(loaded).count
        else:
            counted = lambda some: list(map(len, loaded.encode_batch_fast(some, add_special_tokens=False)))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            held, size = [], 0
            for i, text in enumerate(texts):
                if len(text) > longest:
                    counts[i] = count_long(loaded.encode, text)
                elif text:
                    held.append(i)
                    size += len(text)
                if size > _BATCH_CHARACTERS or (i + 1 == len(texts) and held):
                    for h, c in zip(held, counted([texts[h] for h in held])):
                        counts[h] = c
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["_row", "n_bytes", "n_tokens"],
            )

    return count


def count_tokens(
    docs: DataFrame, tokenizer_path: str, text_column: str = "text", limit: int = LIMIT, longest: int = CHUNK,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, or all) with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Null texts count as empty: no bytes, no tokens. Repeated rows are counted each; an empty table
    gives an empty result; texts over ``longest`` characters are encoded in chunks. Columns
    named like a result are replaced. ``tokenizer_path`` names a file every executor has.
    """
    names = keep or docs.columns
    text = F.coalesce(named(text_column), F.lit(""))
    rows = packed(docs.select(*[named(c) for c in dict.fromkeys([*names, text_column])]), text=text, n_bytes=F.octet_length(text).cast("long"))
    schema = rows.select("_row", "n_bytes").schema.add("n_tokens", "long")
    counted = rows.mapInArrow(_counter(tokenizer_path, longest), schema).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
    return unpacked(counted, names, ["n_bytes", "n_tokens", "over_limit"])
