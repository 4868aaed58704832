"""Language-model scores by a probabilistic suffix tree over words.

The tree holds contexts of up to ``depth`` words. A context is looked at when it occurs
``min_count`` times in the training texts, and retained when its next-word distribution diverges
from that of its longest retained suffix: the mean log ratio of the two, each occurrence
predicted by all others, must reach ``divergence`` nats. A state's distribution is smoothed by
its suffix state's, ``(n + weight * P_suffix(word)) / (count + weight)``; the root's is add-one over
all known words and one unknown. A word is scored by the longest retained suffix of what
precedes it; contexts don't cross documents, and every text closes with an end token.

Texts are hashed to words once, in chunks that hold many documents (a long text is a chunk of its
own). From level to level the chunks ask for what they need: each sends its distinct keys (words,
words in a context, contexts) with its own counts, dealt by hash into buckets; a bucket
adds up the counts of a key over all chunks and answers each chunk. So counting and looking up are
one exchange, a frequent key is one entry per chunk, and no table of the model meets one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from wirelog.llm.compact import by_frequency, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from wirelog.llm.frames import Scratch, named, unpacked
from wirelog.llm.hashing import mix, pieces, word_hashes

DEPTH = 2
MIN_COUNT = 16
DIVERGENCE = 0.05
WEIGHT = 8.0
#: Bytes of text in a chunk, and words of all texts per bucket: what one task holds at a time.
CHUNK_BYTES = 1 << 22
BUCKET_WORDS = 1 << 20
_PIECE = 1 << 20
_END = np.uint64(0x9E3779B97F4A7C15)
_LANES = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
#: Log ratios are added up as whole numbers of this fraction of a nat, so their order can't matter.
_FINE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

#: Of a chunk: its words in order of hash, their order by frequency, its tokens by that order, where
#: texts begin, and which of them to learn from.
_PARTS = ("words", "order", "tokens", "bounds", "train")
CHUNK_SCHEMA = "chunk bigint, n_words bigint, words binary, `order` binary, tokens binary, bounds binary, train binary"
ASKED = "chunk bigint, kind int, bucket int, keys binary, counts binary"
ANSWERED = "chunk bigint, kind int, bucket int, totals binary, total bigint, distinct_keys bigint"


# -- texts to chunks


def _hashes(texts: pa.Array) -> tuple[list, list]:
    """Word hashes of all texts, in parts, and the number of words of each text."""
    parts, sizes = [], []
    for _, some in pieces(texts, _PIECE):
        if len(some) == 1 and len(some[0].as_buffer()) > 2 * _PIECE:
            text, begin, size = some[0].as_buffer().to_pybytes(), 0, 0
            while begin < len(text):
                space = _SPACE.search(text, begin + _PIECE)
                end = space.start() if space else len(text)
                part, _ = word_hashes(pa.array([text[begin:end].decode()], pa.string()))
                parts.append(part)
                size += len(part)
                begin = end
            sizes.append(size)
            continue
        part, starts = word_hashes(some)
        parts.append(part)
        sizes.extend(np.diff(starts).tolist())
    return parts, sizes


def _chunk(rows: list, texts: list, train: list, number: int) -> pa.RecordBatch:
    parts, sizes = [], []
    for some in texts:
        hashed, counted = _hashes(pc.ascii_lower(some))
        parts += hashed
        sizes += counted
    hashed = np.concatenate([*parts, np.empty(0, np.uint64)])
    sizes = np.array(sizes, np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    every = np.empty(bounds[-1], np.uint64)
    ends = np.zeros(bounds[-1], bool)
    ends[bounds[1:] - 1] = True
    every[ends], every[~ends] = _END, hashed
    words, tokens = np.unique(every, return_inverse=True)
    tokens, order = by_frequency(tokens, len(words))
    held = pa.concat_arrays(rows)
    packed = [squeeze_sorted(words), squeeze(order), squeeze(tokens), squeeze(bounds), squeeze(np.concatenate(train))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([len(tokens)], pa.int64()),
            *[pa.array([x], pa.binary()) for x in packed],
            pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
        ],
        names=["chunk", "n_words", *_PARTS, "rows"],
    )


def _chunks(chunk_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        rows, texts, train, size, made = [], [], [], 0, 0
        for batch in batches:
            flags = np.asarray(batch.column("train").to_pylist(), dtype=bool)
            for start, some in pieces(batch.column("text"), chunk_bytes):
                bytes_here = some.nbytes
                if rows and size + bytes_here > chunk_bytes:
                    yield _chunk(rows, texts, train, first + made)
                    rows, texts, train, size, made = [], [], [], 0, made + 1
                rows.append(batch.column("_row").slice(start, len(some)))
                texts.append(some)
                train.append(flags[start : start + len(some)])
                size += bytes_here
        if rows:
            yield _chunk(rows, texts, train, first + made)

    return cut


# -- what a chunk asks, and what it makes of the answers


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sums of their values, and where in the distinct keys each key is."""
    distinct, places = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, places, values)
    return distinct, sums, places


class _Asking:
    """Sends keys, or looks their totals up where the answers are there."""

    def __init__(self, chunk: int, buckets: int, answers: dict):
        self.chunk, self.buckets, self.answers = chunk, buckets, answers
        self.rows: list[tuple] = []

    def total(self, kind: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray | None:
        if not len(keys):
            return np.empty(0, np.int64)
        if kind in self.answers:
            totals = np.concatenate([unsqueeze(data) for _, data in sorted(self.answers[kind].items())])
            # Words are distinct and in order already.
            return totals if len(totals) == len(keys) and kind == 0 else totals[np.unique(keys, return_inverse=True)[1]]
        distinct, sums, places = _grouped(keys, values)
        # Buckets are ranges of keys, so keys in order are buckets in order.
        bucket = ((distinct >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(distinct)]):
            block = squeeze_sorted(distinct[start:end]), squeeze(sums[start:end])
            self.rows.append((kind, int(bucket[start]), *block))
        return None


def _walk(row: dict, asking: _Asking, settings: dict) -> np.ndarray | None:
    """Probability and training count of every token, or nothing while answers are missing."""
    words = unsqueeze_sorted(row["words"])
    tokens = unsqueeze(row["order"])[unsqueeze(row["tokens"])]
    bounds = unsqueeze(row["bounds"])
    sizes = np.diff(bounds)
    train = np.repeat(unsqueeze(row["train"]), sizes)
    own = np.bincount(tokens, weights=train, minlength=len(words)).astype(np.int64)
    counts = asking.total(0, words, own)
    if counts is None:
        return None
    counts = counts[tokens]
    seen = counts
    probability = (counts + 1) / (settings["total"] + settings["distinct"] + 1)
    hashed = words[tokens]
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], sizes)
    context = np.zeros(len(tokens), np.uint64)
    weight, complete = settings["weight"], True
    for depth in range(1, settings["depth"] + 1):
        context[depth:] += hashed[:-depth] * _LANES[depth]
        held = np.zeros(len(tokens), np.int64)
        held[1:] = counts[:-1]
        at = np.flatnonzero((place >= depth) & (held >= settings["min_count"]))
        state = mix(context[at] + np.uint64(depth))
        held, times = held[at], train[at]
        found = asking.total(2 * depth - 1, mix(state + hashed[at] * _LANES[0]), times)
        if found is None:
            return None
        counts = np.zeros(len(tokens), np.int64)
        counts[at] = found
        suffix = probability[at]
        others = (found - 1 + weight * suffix) / (held - 1 + weight)
        gain = np.where(times > 0, np.log(np.maximum(others, 1e-300) / suffix), 0.0)
        gained = asking.total(2 * depth, state, np.rint(gain * _FINE).astype(np.int64))
        if gained is None:
            complete = False
        elif complete:
            kept = gained >= settings["divergence"] * _FINE * held
            probability[at[kept]] = ((found + weight * suffix) / (held + weight))[kept]
    return np.stack([probability, seen]) if complete else None


def _read(table: pa.Table, buckets: int) -> tuple[dict, _Asking]:
    """The chunk of a group of rows, and its answers so far."""
    kinds, answers, row = table.column("kind").to_pylist(), {}, None
    for i, kind in enumerate(kinds):
        if kind < 0:
            row = {name: table.column(name)[i].as_py() for name in ("chunk", *_PARTS)}
        else:
            answers.setdefault(kind, {})[table.column("bucket")[i].as_py()] = table.column("totals")[i].as_py()
    return row, _Asking(row["chunk"], buckets, answers)


def _first_asker(buckets: int, settings: dict):
    ask = _asker(buckets, settings)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from ask(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    return each


def _asker(buckets: int, settings: dict):
    def ask(table: pa.Table) -> pa.Table:
        row, asking = _read(table, buckets)
        _walk(row, asking, settings)
        kinds, places, keys, counts = zip(*asking.rows) if asking.rows else [()] * 4
        return pa.table(
            [
                pa.array([row["chunk"]] * len(kinds), pa.int64()),
                pa.array(kinds, pa.int32()),
                pa.array(places, pa.int32()),
                pa.array(keys, pa.binary()),
                pa.array(counts, pa.binary()),
            ],
            names=["chunk", "kind", "bucket", "keys", "counts"],
        )

    return ask


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of one bucket's keys over all chunks, back in the order in which each chunk asked."""
    keys = [unsqueeze_sorted(k) for k in table.column("keys").to_pylist()]
    counts = [unsqueeze(c) for c in table.column("counts").to_pylist()]
    _, sums, places = _grouped(np.concatenate(keys), np.concatenate(counts))
    answers = np.split(sums[places], np.cumsum([len(k) for k in keys])[:-1])
    others = [None] * (len(keys) - 1)
    return pa.table(
        [
            table.column("chunk"),
            table.column("kind"),
            table.column("bucket"),
            pa.array([squeeze(a) for a in answers], pa.binary()),
            pa.array([int(sums.sum()), *others], pa.int64()),
            pa.array([int((sums > 0).sum()), *others], pa.int64()),
        ],
        names=["chunk", "kind", "bucket", "totals", "total", "distinct_keys"],
    )


def _scorer(buckets: int, settings: dict):
    def score(table: pa.Table) -> pa.Table:
        row, asking = _read(table, buckets)
        probability, seen = _walk(row, asking, settings)
        starts = unsqueeze(row["bounds"])
        base = np.log10((seen + 1) / (settings["total"] + settings["distinct"] + 1))
        at = table.column("kind").to_pylist().index(-1)
        rows = table.column("rows")[at].values
        return pa.table(
            [
                rows,
                pa.array(np.diff(starts), pa.int64()),
                pa.array(np.add.reduceat((seen > 0).astype(np.int64), starts[:-1]), pa.int64()),
                pa.array(np.add.reduceat(base, starts[:-1]), pa.float64()),
                pa.array(np.add.reduceat(np.log10(probability), starts[:-1]), pa.float64()),
            ],
            names=["_row", "n_tokens", "n_known", "base_score", "score"],
        )

    return score


def score_texts(
    docs: DataFrame, train: Column, text_column: str = "text", keep: list[str] | None = None, depth: int = DEPTH,
    min_count: int = MIN_COUNT, divergence: float = DIVERGENCE, weight: float = WEIGHT,
    chunk_bytes: int = CHUNK_BYTES, bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, or all) with log10 probabilities of their whole texts.

    ``train`` marks the rows to learn from (null: no). Added: ``held_out``, ``n_tokens`` and
    ``n_known`` (words and the end token; those seen in training), ``train_tokens`` (of the whole
    training set), ``base_score`` (root only) and ``score`` (the tree). Null texts are empty: one end token.
    Repeated rows are learnt from and scored each; ids are not looked at. Columns named like a
    result are replaced. An empty table gives an empty result.
    """
    if depth < 1 or min_count < 2 or weight <= 0:
        raise ValueError("needs a depth of 1, contexts of 2 occurrences and a positive weight, or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    names = keep or docs.columns
    learnt = F.coalesce(train, F.lit(False))
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    row = F.struct(*[named(c).alias(c) for c in names], (~learnt).alias("_held_out"))
    text = F.coalesce(named(text_column), F.lit(""))
    rows = docs.select(row.alias("_row"), text.alias("text"), learnt.alias("train"))
    held = StructType.fromDDL(CHUNK_SCHEMA).add("rows", ArrayType(rows.schema["_row"].dataType))
    chunks = scratch.store(rows.mapInArrow(_chunks(chunk_bytes), held), "chunks", rows_per_file=16)
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-n_words // bucket_words))
    settings = {"depth": depth, "min_count": min_count, "divergence": divergence, "weight": weight}
    settings |= {"total": 0, "distinct": 0}
    answers = None
    for trip in range(depth + 2):
        if trip == 0:
            asked = _met(chunks.drop("rows"), None).mapInArrow(_first_asker(buckets, settings), ASKED)
        else:
            asked = _met(chunks.drop("rows"), answers).groupBy("chunk").applyInArrow(_asker(buckets, settings), ASKED)
        more = scratch.store(asked.groupBy("kind", "bucket").applyInArrow(_add_up, ANSWERED), f"answers-{trip}")
        del asked
        scratch.tidy()
        if trip == 0:
            total, distinct = more.agg(F.sum("total"), F.sum("distinct_keys")).first()
            settings |= {"total": total or 0, "distinct": distinct or 0}
        answers = more if answers is None else answers.unionByName(more)
    schema = StructType().add("_row", chunks.schema["rows"].dataType.elementType)
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    scored = _met(chunks, answers).groupBy("chunk").applyInArrow(_scorer(buckets, settings), schema)
    scored = scored.withColumns(
        {"held_out": F.col("_row._held_out"), "train_tokens": F.lit(settings["total"]).cast("long")}
    )
    return unpacked(scored, names, added)


def _met(chunks: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Chunks (kind -1) and the answers to them, in one table."""
    marked = chunks.drop("n_words").withColumn("kind", F.lit(-1))
    if answers is None:
        return marked
    return marked.unionByName(answers.select("chunk", "kind", "bucket", "totals"), allowMissingColumns=True)
