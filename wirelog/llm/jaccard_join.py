"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of hashed shingles of five words (a shorter text is one shingle of all its
words). Texts with the same set form a class, and one row stands for it from then on. Classes
that agree in four MinHash values of one of 32 bands are linked to the least class of that
bucket, and linked classes form candidate neighbourhoods; only their shingles are ever moved.
In a neighbourhood, pairs are compared sixteen MinHash values at a time and dropped as soon as
the posterior probability of a Jaccard similarity of at least the threshold (uniform prior)
falls below ``tolerance``. What is left after 128 values is verified exactly on the sets.

A pair at the threshold of 0.8 shares no bucket with probability 5e-8, a more similar pair
with less; the pruning loses one with probability ``tolerance`` at most per comparison.
Neighbourhoods above ``BLOCK_SHINGLES`` or ``BLOCK_CLASSES`` are dealt out as pairs of blocks
of similar set size, so a task holds two blocks whatever the size of the group, and gives one
row per class and block: counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelog.llm.components import connected_components
from wirelog.llm.frames import Scratch, named
from wirelog.llm.hashing import mix, pieces, shingles, word_hashes

WIDTH = 5
THRESHOLD = 0.8
TOLERANCE = 1e-9
HASHES = 128
ROWS_PER_BAND = 4
STEP = 16
BLOCK_SHINGLES = 1 << 20
BLOCK_CLASSES = 1024
#: A little over 1 / 0.8, so that sets of similar texts lie at most one size level apart.
LEVEL = math.log(1.2501)

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_FACTORS = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each step of values, the fewest matches that keep a pair.

    With a uniform prior, m matches of n give the posterior Beta(m + 1, n - m + 1), and its
    mass above the threshold is the chance of at most m successes in n + 1 trials.
    """
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        needed.append(m)
    return needed


def signature(members: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes."""
    low = (members >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), 2048):
        table = np.multiply.outer(_FACTORS, low[start : start + 2048])
        table += _SHIFTS[:, None]
        np.minimum(best, table.min(axis=1), out=best)
    return best


def digest_of(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def _bands(values: np.ndarray) -> np.ndarray:
    rows = values.astype(np.uint64).reshape(-1, ROWS_PER_BAND)
    total = np.arange(len(rows), dtype=np.uint64)
    for j in range(ROWS_PER_BAND):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return total.view(np.int64)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, part in pieces(texts):
        hashes, starts = word_hashes(part)
        for i in range(len(part)):
            yield shingles(hashes[starts[i] : starts[i + 1]], WIDTH)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes, bands = [], [], []
        for members in _sets(batch.column("text")):
            sizes.append(len(members))
            digests.append(digest_of(members) if len(members) else None)
            bands.append(_bands(signature(members)) if len(members) else np.empty(0, np.int64))
        lengths = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        values = np.concatenate(bands) if bands else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(digests, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(lengths), pa.array(values)),
            ],
            names=["doc_id", "digest", "n", "bands"],
        )


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the texts that have the digest they are asked for."""
    for batch in batches:
        keep, members_of = [], []
        for i, members in enumerate(_sets(batch.column("text"))):
            if len(members) and digest_of(members) == batch.column("digest")[i].as_py():
                keep.append(i)
                members_of.append(members.tobytes())
        kept = batch.drop_columns(["text"]).take(pa.array(keep, pa.int64()))
        yield kept.append_column("members", pa.array(members_of, pa.binary()))


class _Forest:
    """Union-find over the rows of a block; the least root wins."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


def surviving_pairs(left: np.ndarray, right: np.ndarray, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures that no step drops."""
    matches = np.zeros((len(left), len(right)), dtype=np.uint8)
    for j in range(STEP):
        matches += left[:, j, None] == right[None, :, j]
    i, k = np.nonzero(matches >= needed[0])
    counts = matches[i, k].astype(np.int64)
    for step in range(1, len(needed)):
        columns = slice(step * STEP, (step + 1) * STEP)
        for part in range(0, len(i), 1 << 16):
            piece = slice(part, part + (1 << 16))
            counts[piece] += (left[i[piece], columns] == right[k[piece], columns]).sum(axis=1)
        alive = counts >= needed[step]
        i, k, counts = i[alive], k[alive], counts[alive]
    return i, k


def _common(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the index pairs."""
    if len(i) < 64:
        return np.array(
            [len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, k)], dtype=np.int64
        )
    rows, columns = np.unique(i), np.unique(k)
    at_row, at_column = np.searchsorted(rows, i), np.searchsorted(columns, k)
    vocabulary = np.unique(np.concatenate([left[a] for a in rows]))
    total = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for start in range(0, len(vocabulary), 8192):
        words = vocabulary[start : start + 8192]
        total += _incidence([left[a] for a in rows], words) @ _incidence([right[b] for b in columns], words).T
    return total[at_row, at_column].astype(np.int64)


def _incidence(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    table = np.zeros((len(sets), len(words)), dtype=np.float32)
    for row, members in enumerate(sets):
        low, high = np.searchsorted(members, [words[0], words[-1]])
        inside = members[low : high + 1]
        at = np.searchsorted(words, inside)
        at = at[(at < len(words))]
        hit = at[words[at] == inside[: len(at)]]
        table[row, hit] = 1
    return table


def _linked(threshold: float, needed: list[int]):
    def compare(table: pa.Table) -> pa.Table:
        own = table.column("own").to_pylist()
        digests = table.column("digest").to_pylist()
        order = sorted(range(len(digests)), key=lambda x: digests[x])
        order = [x for at, x in enumerate(order) if at == 0 or digests[x] != digests[order[at - 1]]]
        column = table.column("members")
        sets = [np.frombuffer(column[x].as_py(), dtype=np.uint64) for x in order]
        copies = np.array(table.column("copies").to_pylist(), dtype=np.int64)[order]
        sides = np.array([own[x] for x in order])
        signs = np.stack([signature(s) for s in sets])
        links = np.zeros(len(order), dtype=np.int64)
        forest = _Forest(len(order))
        within = (sides == 0).all()
        lower = np.flatnonzero(sides != 2)
        upper = lower if within else np.flatnonzero(sides == 2)
        for start in range(0, len(lower), 256):
            rows = lower[start : start + 256]
            i, k = surviving_pairs(signs[rows], signs[upper], needed)
            i, k = rows[i], upper[k]
            if within:
                i, k = i[i < k], k[i < k]
            if not len(i):
                continue
            shared = _common(sets, sets, i, k)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            # whole numbers: shared / union >= threshold
            alike = shared * 1000 >= round(threshold * 1000) * (sizes[i] + sizes[k] - shared)
            i, k = i[alike], k[alike]
            np.add.at(links, i, copies[k])
            np.add.at(links, k, copies[i])
            for a, b in zip(i.tolist(), k.tolist()):
                forest.join(a, b)
        touched = np.flatnonzero(links)
        roots = [forest.find(int(x)) for x in touched]
        return pa.table(
            {
                "digest": pa.array([digests[order[x]] for x in touched], pa.binary()),
                "root": pa.array([digests[order[x]] for x in roots], pa.binary()),
                "links": pa.array(links[touched], pa.int64()),
            }
        )

    return compare


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` and ``n_links``.

    ``class_id`` is the least id in the row's group (texts linked directly or through others),
    ``n_links`` the number of other rows whose text has a similarity of at least ``threshold``.
    Null and empty texts, and texts of white space, are similar to nothing: their class is
    their own id. A repeated row is one more copy. A null id is never least unless the group
    has no other. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard-join")
    rows = docs.select(named(id_column).alias("doc_id"), F.coalesce(named(text_column), F.lit("")).alias("text"))
    described = scratch.store(
        rows.mapInArrow(_describe, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                        "digest binary, n bigint, bands array<bigint>"),
        "described",
    )
    classes = scratch.store(
        described.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n"),
             F.first("bands").alias("bands"))
        .withColumn("key", F.xxhash64("digest")),
        "classes",
    )
    candidates = _candidates(classes, scratch)
    linked = scratch.store(_compare(rows, candidates, threshold, tolerance), "linked")
    groups = connected_components(linked.select(F.col("digest").alias("a"), F.col("root").alias("b")), scratch)
    counts = linked.groupBy("digest").agg(F.sum("links").alias("links"))
    known = classes.select("digest", "first_id", "copies")
    member = known.join(groups, known.digest == groups.node, "left").select(
        "digest", "first_id", "copies", F.coalesce("root", "digest").alias("root")
    )
    least = member.groupBy("root").agg(F.min("first_id").alias("class_id"))
    of_class = (
        member.join(least, "root")
        .join(counts, "digest", "left")
        .select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return described.select("doc_id", "digest").join(of_class, "digest", "left").select(
        "doc_id",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def _candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Classes that share a bucket with another, with their neighbourhood ``comp``."""
    rows = classes.select("key", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("key").alias("b"), F.max("key").alias("most")).where("b <> most")
    # Written, so that the join shuffles both sides anew and can split a crowded bucket.
    buckets = scratch.store(shared.select("bucket", "b"), "buckets")
    edges = rows.join(buckets, "bucket").where("key <> b").select(F.col("key").alias("a"), "b").distinct()
    found = connected_components(edges, scratch)
    return scratch.store(
        classes.join(found, classes.key == found.node).select(
            "digest", "first_id", "copies", "n", "key", F.col("root").alias("comp")
        ),
        "candidates",
    )


def _blocks(candidates: DataFrame) -> DataFrame:
    """Each candidate with every block, or pair of blocks, it is compared in.

    ``own`` is 0 where a block meets itself, else 1 for the lower and 2 for the upper block.
    """
    totals = candidates.groupBy("comp").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    sized = candidates.join(totals, "comp")
    small = (F.col("total") <= BLOCK_SHINGLES) & (F.col("members") <= BLOCK_CLASSES)
    plain = sized.where(small).withColumns(
        {c: F.lit(0) for c in ("level_1", "block_1", "level_2", "block_2", "own")}
    )
    crowded = sized.where(~small).withColumn("level", F.floor(F.log(F.col("n")) / LEVEL).cast("int"))
    levels = crowded.groupBy("comp", "level").agg(
        F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES)).cast("int").alias("parts")
    )
    at = lambda by, name: levels.select("comp", (F.col("level") + by).alias("level"), F.col("parts").alias(name))
    placed = (
        crowded.join(at(0, "same"), ["comp", "level"])
        .join(at(-1, "above"), ["comp", "level"], "left")
        .join(at(1, "below"), ["comp", "level"], "left")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("same")).cast("int"))
    )
    numbers = lambda count: F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda count, by: F.transform(
        numbers(F.coalesce(count, F.lit(0))), lambda b: F.struct((F.col("level") + by).alias("level"), b.alias("block"))
    )
    met = placed.withColumn(
        "other", F.explode(F.concat(meet(F.col("same"), 0), meet(F.col("above"), 1), meet(F.col("below"), -1)))
    )
    mine = F.struct("level", "block")
    pairs = met.select(
        *candidates.columns,
        F.least(mine, F.col("other")).alias("one"),
        F.greatest(mine, F.col("other")).alias("two"),
        F.when(mine == F.col("other"), 0).when(mine < F.col("other"), 1).otherwise(2).alias("own"),
    )
    dealt = pairs.select(
        *candidates.columns,
        F.col("one.level").alias("level_1"), F.col("one.block").alias("block_1"),
        F.col("two.level").alias("level_2"), F.col("two.block").alias("block_2"),
        "own",
    )
    return plain.select(dealt.columns).unionByName(dealt)


def _compare(rows: DataFrame, candidates: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    wanted = candidates.select(
        "digest", F.col("first_id").alias("doc_id"), F.struct(*candidates.columns).alias("asked")
    )
    # sorted and merged at every size: the wanted ids grow with the corpus
    wanted = wanted.hint("merge")
    texts = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.doc_id)).select("digest", "text")
    sets = texts.mapInArrow(_gather, "digest binary, members binary")
    placed = _blocks(candidates).select(
        "digest", "copies", "comp", "level_1", "block_1", "level_2", "block_2", "own"
    )
    return (
        placed.join(sets, "digest")
        .groupBy("comp", "level_1", "block_1", "level_2", "block_2")
        .applyInArrow(
            _linked(threshold, least_matches(threshold, tolerance)), "digest binary, root binary, links bigint"
        )
    )
