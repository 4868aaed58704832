"""Which tokens of two tokenizers stand for the same bytes, by sparse matrix products.

The incidence of tokens and bytes is a matrix in compressed sparse rows (CSR): ``A`` for one
tokenizer, ``B`` for the other. Two tokens overlap where ``A`` times the transpose of ``B`` is not
zero, and the entry is the number of bytes they share. Byte offsets where tokens of both
end cut the tokens into groups; the product of the two token-group incidences links all tokens of a
group. Rows are multiplied one after another (Gustavson), a block of rows at a time.

A chunk of texts is laid end to end, so one product serves many texts; texts meet at a cut. The
links of a chunk are numbered by id pair. Pairs are counted over all chunks, and each chunk
gets back the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from wirelog.llm.compact import by_frequency, squeeze, unsqueeze
from wirelog.llm.frames import Scratch, named, unpacked
from wirelog.llm.hashing import pieces

CHUNK_BYTES = 1 << 22
#: Entries that a product expands at a time.
BLOCK = 1 << 20


# -- matrices


@dataclass
class Csr:
    """A matrix of zeros and whole numbers; without ``values`` every entry is one."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def incidence(lengths: np.ndarray) -> Csr:
    """Rows of consecutive columns: a token and its bytes."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def membership(columns: np.ndarray, width: int) -> Csr:
    """One column per row: a token and its group."""
    return Csr(np.arange(len(columns) + 1), columns, width)


def transposed(matrix: Csr) -> Csr:
    order = np.argsort(matrix.columns, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(matrix.columns, minlength=matrix.width))])
    return Csr(starts.astype(np.int64), matrix.rows[order], len(matrix.starts) - 1)


def row_products(left: Csr, right: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of ``left`` times ``right``, both without values, in row order.

    Each row of the product is the sum of the rows of ``right`` that the row of ``left`` names. At
    most ``block`` terms are held, or those of one row.
    """
    terms = np.diff(right.starts)[left.columns]
    before = np.concatenate([[0], np.cumsum(terms)])[left.starts]
    first, last = 0, len(left.starts) - 1
    while first < last:
        end = max(first + 1, int(np.searchsorted(before, before[first] + block, side="right")) - 1)
        entries = slice(left.starts[first], left.starts[end])
        counts = terms[entries]
        rows = np.repeat(np.repeat(np.arange(first, end), np.diff(left.starts[first : end + 1])), counts)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        columns = right.columns[np.repeat(right.starts[left.columns[entries]], counts) + within]
        keys = rows * right.width + columns
        if np.any(keys[1:] < keys[:-1]):
            keys.sort()
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        found = keys[new]
        yield found // right.width, found % right.width, np.diff(np.append(new, len(keys)))
        first = end


# -- tokenizers


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: itself if it prints, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Ids of a byte-level BPE in a tokenizers file; special strings are plain text.

    Where ids follow the merges' order, as in the published files, tiktoken gives the same ids
    several times faster; it can't take some very long runs, which go to the library of the file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        letters = _byte_letters()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.bytes: list[bytes] = [b""] * self.library.get_vocab_size()
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.fast = self._ranked(path, vocabulary)

    def _ranked(self, path: str, vocabulary: dict):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in described["model"]["merges"]]
        plain = described.get("normalizer") is None and described["pre_tokenizer"]["type"] == "ByteLevel"
        if not plain or any(vocabulary.get(token) != 256 + i for i, token in enumerate(merged)):
            return None
        ranks = {self.bytes[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except KeyboardInterrupt:
                raise
            except BaseException as error:  # a panic is no Exception
                if type(error).__name__ != "PanicException":
                    raise
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class _Side:
    """A tokenizer with tables of its tokens' lengths and decimal names."""

    def __init__(self, model):
        self.model = model
        self.lengths = np.array([len(b) for b in model.bytes], np.int64)
        self.names = np.array([[sep + str(i) for i in range(len(model.bytes))] for sep in ("", ",", ";", "|")], object)

    def tokens(self, text: str, whole: bytes) -> list[int] | None:
        ids = self.model.encode(text)
        return ids if b"".join(map(self.model.bytes.__getitem__, ids)) == whole else None


# -- chunks


class Laid:
    """Texts end to end: token ids of both sides, their groups, and where each text ends."""

    def __init__(self, texts: list[str | None], a: _Side, b: _Side):
        found_a, found_b = [], []
        for text in texts:
            ids_a = ids_b = None
            if text:
                whole = b" " + text.encode()
                ids_a = a.tokens(" " + text, whole)
                ids_b = b.tokens(text, whole) if ids_a is not None else None
            found_a.append(ids_a if ids_b is not None else ())
            found_b.append(ids_b if ids_b is not None else ())
        self.a, self.b = (np.array([i for ids in found for i in ids], np.int64) for found in (found_a, found_b))
        self.ends_a, self.ends_b = (
            np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int64) for found in (found_a, found_b)
        )
        self.bytes_a, self.bytes_b = a.lengths[self.a], b.lengths[self.b]
        stops_a, stops_b = np.cumsum(self.bytes_a), np.cumsum(self.bytes_b)
        cuts = np.intersect1d(stops_a, stops_b, assume_unique=True)
        self.groups = len(cuts)
        self.group_a, self.group_b = np.searchsorted(cuts, stops_a), np.searchsorted(cuts, stops_b)
        reached = np.concatenate([[0], stops_a])[self.ends_a]
        self.ends_groups = np.searchsorted(cuts, reached, side="right")
        self.names = a.names, b.names

    def overlaps(self, block: int = BLOCK):
        return row_products(incidence(self.bytes_a), transposed(incidence(self.bytes_b)), block)

    def group_links(self, block: int = BLOCK):
        return row_products(
            membership(self.group_a, self.groups), transposed(membership(self.group_b, self.groups)), block
        )

    def written_groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        per_a, per_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        before_a, before_b = (np.concatenate([[0], np.cumsum(per)]) for per in (per_a, per_b))
        head_a = np.arange(len(self.a)) == before_a[self.group_a]
        head_b = np.arange(len(self.b)) == before_b[self.group_b]
        mark_a = np.where(head_a, 2, 1)
        mark_a[self.ends_a[:-1][np.diff(self.ends_a) > 0]] = 0
        written = np.empty(len(self.a) + len(self.b), object)
        written[np.arange(len(self.a)) + before_b[self.group_a]] = self.names[0][mark_a, self.a]
        written[np.arange(len(self.b)) + before_a[self.group_b + 1]] = self.names[1][np.where(head_b, 3, 1), self.b]
        bounds = (self.ends_a + self.ends_b).tolist()
        return ["".join(written[s:e].tolist()) for s, e in zip(bounds, bounds[1:])]


def _sides(a_path: str, b_path: str) -> tuple[_Side, _Side]:
    return _Side(ByteLevel(a_path)), _Side(Pieces(b_path))


CHUNKED = (
    "chunk bigint, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups array<string>, pairs array<struct<a:int,b:int,n:bigint>>, links binary"
)


def _one_row(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunk(number: int, rows: list, texts: list, sides) -> pa.RecordBatch:
    laid = Laid([t for some in texts for t in some.to_pylist()], *sides)
    per_row, keys = np.zeros(len(laid.a), np.int64), []
    for at_a, at_b, _ in laid.overlaps():
        per_row += np.bincount(at_a, minlength=len(laid.a))
        keys.append(laid.a[at_a] << 32 | laid.b[at_b])
    pairs, links, counts = np.unique(
        np.concatenate([*keys, np.empty(0, np.int64)]), return_inverse=True, return_counts=True
    )
    links, frequent = by_frequency(links, len(pairs))
    pairs, counts = pairs[frequent], counts[frequent]
    n_links = np.diff(np.concatenate([[0], np.cumsum(per_row)])[laid.ends_a])
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in laid.written_groups()]
    counted = pa.StructArray.from_arrays(
        [pa.array(pairs >> 32, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(counts, pa.int64())],
        names=["a", "b", "n"],
    )
    lists = [np.diff(laid.ends_a), np.diff(laid.ends_b), np.diff(laid.ends_groups), n_links]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            *[_one_row(pa.array(numbers, pa.int64())) for numbers in lists],
            _one_row(pa.array(digests, pa.string())),
            _one_row(counted),
            pa.array([squeeze(links)], pa.binary()),
            _one_row(pa.concat_arrays(rows)),
        ],
        names=["chunk", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links", "rows"],
    )


def _slices(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, list, list]]:
    """Numbered runs of rows and texts, of ``chunk_bytes`` or one text at most."""
    number = TaskContext.get().partitionId() << 32
    rows, texts, size = [], [], 0
    for batch in batches:
        for start, some in pieces(batch.column("text"), chunk_bytes):
            if rows and size + some.nbytes > chunk_bytes:
                yield number, rows, texts
                rows, texts, size, number = [], [], 0, number + 1
            rows.append(batch.column("_row").slice(start, len(some)))
            texts.append(some)
            size += some.nbytes
    if rows:
        yield number, rows, texts


def _chunker(a_path: str, b_path: str, chunk_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_path, b_path)
        for number, rows, texts in _slices(batches, chunk_bytes):
            yield _chunk(number, rows, texts, sides)

    return cut


def _finish(chunk: pa.Table, counted: pa.Table) -> pa.Table:
    """The texts of one chunk with sums over their links."""
    lists = {name: chunk.column(name)[0].values for name in ("rows", "n_a", "n_b", "n_groups", "n_links", "groups")}
    n_links = lists["n_links"].to_numpy(zero_copy_only=False)
    links = unsqueeze(chunk.column("links")[0].as_py())
    count, best = np.zeros(counted.num_rows, np.int64), np.zeros(counted.num_rows, np.int64)
    places = counted.column("place").to_numpy()
    count[places], best[places] = counted.column("count").to_numpy(), counted.column("best").to_numpy()
    ends = np.concatenate([[0], np.cumsum(n_links)])
    sums = [np.diff(np.concatenate([[0], np.cumsum(values[links])])[ends]) for values in (best, count)]
    return pa.table(
        [*lists.values(), *[pa.array(s, pa.int64()) for s in sums]],
        names=["_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"],
    )


ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _rows_and_text(docs: DataFrame, names: list[str], text_column: str) -> DataFrame:
    row = F.struct(*[named(c).alias(c) for c in names])
    return docs.select(row.alias("_row"), F.coalesce(named(text_column), F.lit("")).alias("text"))


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, text_column: str = "text", keep: list[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, or all) with what the two tokenizers share on each text.

    ``a_path`` is a byte-level BPE (tokenizers), given a space before the text, ``b_path`` a
    sentencepiece model, which adds one; every executor has both files. Added: tokens ``n_a`` and ``n_b``, ``n_groups``,
    overlap links ``n_links``, links whose id pair is the most frequent of its B id ``n_best`` (ties
    included), the sum of the pairs' counts over all texts ``count_sum``, ``groups_sha256``. Texts that are
    null or empty, or that either side doesn't give back byte by byte, have zeros and ''.
    Repeated rows count each. Columns named like a result are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    names = keep or docs.columns
    rows = _rows_and_text(docs, names, text_column)
    schema = StructType.fromDDL(CHUNKED).add("rows", ArrayType(rows.schema["_row"].dataType))
    chunks = scratch.store(rows.mapInArrow(_chunker(a_path, b_path, chunk_bytes), schema), "chunks", rows_per_file=16)
    pairs = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair")).select("chunk", "place", "pair.*")
    counts = scratch.store(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    highest = scratch.store(counts.groupBy("b").agg(F.max("count").alias("highest")), "highest")
    best = (F.col("count") == F.col("highest")).cast("long")
    rated = scratch.store(counts.join(highest, "b").select("a", "b", "count", best.alias("best")), "rated")
    answers = pairs.drop("n").join(rated, ["a", "b"]).select(F.col("chunk").alias("of"), "place", "count", "best")
    out = StructType().add("_row", chunks.schema["rows"].dataType.elementType)
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        out = out.add(name, "long")
    out = out.add("groups_sha256", "string").add("n_best", "long").add("count_sum", "long")
    finished = chunks.drop("pairs").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_finish, out)
    return unpacked(finished, names, ADDED)


def _linker(a_path: str, b_path: str, kind: str, chunk_bytes: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_path, b_path)
        for _, rows, texts in _slices(batches, chunk_bytes):
            laid, held = Laid([t for some in texts for t in some.to_pylist()], *sides), pa.concat_arrays(rows)
            for at_a, at_b, shared in laid.overlaps() if kind == "overlap" else laid.group_links():
                text = np.searchsorted(laid.ends_a, at_a, side="right") - 1
                numbers = [
                    at_a - laid.ends_a[text], at_b - laid.ends_b[text], laid.a[at_a], laid.b[at_b],
                    laid.group_a[at_a] - laid.ends_groups[text],
                ]
                if kind == "overlap":
                    numbers.append(shared)
                names = LINKED if kind == "overlap" else LINKED[:-1]
                yield pa.RecordBatch.from_arrays(
                    [held.take(pa.array(text)), *[pa.array(n, pa.int64()) for n in numbers]], names=["_row", *names]
                )

    return link


LINKED = ["a_place", "b_place", "a_id", "b_id", "group", "shared_bytes"]


def token_links(
    docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap", text_column: str = "text",
    keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per linked pair of tokens of each text, with ``keep`` columns (all by default).

    ``kind`` is ``overlap`` (with ``shared_bytes``) or ``group``. Added: places and ids of both
    tokens and the ``group`` within the text, from 0. Texts as in ``align_tokens``; rows come a block
    at a time, however large a group is.
    """
    if kind not in ("overlap", "group"):
        raise ValueError(f"links are by overlap or group, not {kind!r}")
    names, added = keep or docs.columns, LINKED if kind == "overlap" else LINKED[:-1]
    rows = _rows_and_text(docs, names, text_column)
    schema = StructType(rows.select("_row").schema.fields)
    for name in added:
        schema = schema.add(name, "long")
    return unpacked(rows.mapInArrow(_linker(a_path, b_path, kind, chunk_bytes), schema), names, added)
