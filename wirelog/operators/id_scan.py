"""Arrival-ordered tracking of ids, parallel even within one sender.

The memory of a sender (see ``id_state``) depends on all its earlier arrivals, but what a
whole partition does to it has a description of constant size, and descriptions compose (see
``id_futures``). So the rows are range-partitioned by (sender, arrival), pinned, and read twice:

1. every partition describes what it does to the memory of its first and last sender;
2. descriptions are folded, ``FOLD`` neighbours at a time, until one group holds a sender's
   folds; from there the memories that partitions start with are found on the way back down;
3. every partition is read again behind a row that says what it starts with.

A description lists few jumps. Where the memory that comes in makes one that is not listed,
its future is not known, and the partitions are described again with more.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelog.operators.id_futures import Futures, Rules, Stretch, packed, unpacked
from wirelog.operators.id_state import IdMemory, observe, remaining_holes
from wirelog.operators.ordering import sorted_runs
from wirelog.schemas import ARRIVAL, SENDER
from wirelog.session import cut_lineage, duration_us

#: Neighbours folded at a time, and jumps that a description lists at first.
FOLD = 64
JUMPS = 8

_SENDER = {"listener": "string", "sender_host": "string", "sender_port": "int"}
DESCRIBED = _SENDER | {"part": "int", "role": "string", "body": "string"}
FOLDED = _SENDER | {"place": "bigint", "body": "string"}
STARTED = _SENDER | {"place": "bigint", "start": "string", "known": "boolean"}
TRACKED = _SENDER | {
    "msg_id": "bigint",
    "us": "bigint",
    "seq": "bigint",
    "kind": "string",
    "lease": "int",
    "epoch": "int",
    "holes": "int",
}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _frame(rows: list, columns: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(columns), dtype=object)


def _rows(batch: pd.DataFrame, names: tuple):
    senders = zip(batch["listener"], batch["sender_host"], batch["sender_port"].tolist())
    return zip(senders, *(batch[name].tolist() for name in names))


def describe(rules: Rules):
    """Step 1. Roles: ``head`` and ``tail`` of a partition with several senders; ``whole`` for one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = current = None
        memory, futures = IdMemory(), Futures(rules.capacity, rules.max_hole, rules.limit)
        part = first_us = last_us = lease = 0
        for batch in batches:
            rows = list(_rows(batch, ("part", "msg_id", "us", "seq")))
            turns = [at for at, row in enumerate(rows) if row[0] != (rows[at - 1][0] if at else current)]
            if turns and current is None:
                first, part, first_us = rows[0][0], rows[0][1], rows[0][3]
                current, last_us, turns = first, first_us, turns[1:]
            if turns:
                # A sender that ends inside the partition needs no description.
                current, memory, lease, futures = rows[turns[-1]][0], IdMemory(), 0, None
                rows = rows[turns[-1] :]
                last_us = rows[0][3]
            for _, _, msg_id, us, _ in rows:
                if us - last_us >= rules.idle_us:
                    memory, lease, futures = IdMemory(), lease + 1, None
                if futures is None:
                    observe(memory, msg_id, rules.capacity, rules.max_hole)
                else:
                    futures.add(msg_id)
                last_us = us
        if current is None:
            return
        if futures is not None:
            stretch = Stretch.of(futures, first_us, last_us)
        else:
            stretch = Stretch.constant(first_us, last_us, lease, memory)
        if current == first:
            yield _frame([[*current, part, "whole", stretch.to_json()]], DESCRIBED)
            return
        head = [*first, part, "head", None]
        yield _frame([head, [*current, part, "tail", stretch.to_json()]], DESCRIBED)

    return run


def _fold(rules: Rules):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        whole = None
        for body in rows["body"]:
            if body is None:
                continue  # a head is a sender's last row
            stretch = Stretch.from_json(body)
            whole = stretch if whole is None else whole.followed_by(stretch, rules)
        sender = rows[list(_SENDER)].iloc[0].tolist()
        block = int(rows["place"].iloc[0]) // FOLD
        return _frame([[*sender, block, whole and whole.to_json()]], FOLDED)

    return run


def _starts(rows: pd.DataFrame, start: str | None, known: bool, rules: Rules) -> pd.DataFrame:
    """What each of up to ``FOLD`` neighbours starts with, the first with ``start``."""
    found = []
    for *sender, place, body in rows.sort_values("place")[list(FOLDED)].itertuples(index=False):
        found.append([*sender, place, start, known])
        if body is None or not known:
            continue
        stretch = Stretch.from_json(body)
        memory, lease = None, 0
        if start is not None:
            memory, lease, last_us = json.loads(start)
            memory, broke = unpacked(memory), stretch.breaks(last_us, rules)
            memory, lease = None if broke else memory, lease + broke
        memory = stretch.after(memory, rules)
        known = memory is not None
        start = json.dumps([packed(memory), lease + stretch.leases, stretch.last_us]) if known else None
    return _frame(found, STARTED)


def _first_starts(rules: Rules):
    return lambda rows: _starts(rows, None, True, rules)


def _later_starts(rules: Rules):
    def run(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _starts(rows, block["start"].iloc[0], bool(block["known"].iloc[0]), rules)

    return run


def starting_memories(described: DataFrame, rows_of_one: int, rules: Rules) -> DataFrame:
    """Step 2: ``start`` of every row of ``described`` (sender, ``place``, ``body``), by place.

    ``rows_of_one`` bounds the rows of one sender. Null bodies are last rows, which lead nowhere.
    """
    if rows_of_one <= FOLD:
        return described.groupBy(*SENDER).applyInPandas(_first_starts(rules), _ddl(STARTED))
    block = F.floor(F.col("place") / FOLD)
    blocks = described.select(*FOLDED, block.alias("block"))
    folded = blocks.groupBy(*SENDER, "block").applyInPandas(_fold(rules), _ddl(FOLDED))
    outer = starting_memories(folded, -(-rows_of_one // FOLD), rules)
    named = outer.select(*[F.col(c).alias(f"of_{c}") for c in (*SENDER, "place")], "start", "known")
    within = blocks.groupBy(*SENDER, "block").cogroup(named.groupBy(*[f"of_{c}" for c in (*SENDER, "place")]))
    return within.applyInPandas(_later_starts(rules), _ddl(STARTED))


def track(rules: Rules, every: bool):
    """Step 3: one row per arrival and one where a lease ends, or those with holes only.

    Rows with order 0 come first in their partition: what its first sender starts with, and
    whether its last sender goes on elsewhere.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = current = start = None
        memory, lease, last_us, continues = IdMemory(), 0, 0, False

        def lease_end() -> list:
            holes = remaining_holes(memory, rules.max_hole)
            return [*current, None, last_us, None, "lease_end", lease, memory.epoch, holes]

        names = ("part", "order", "msg_id", "us", "seq", "start", "continues")
        for batch in batches:
            found = []
            for sender, in_part, order, msg_id, us, seq, given, goes_on in _rows(batch, names):
                if in_part != part:
                    if current is not None and not continues:
                        found.append(lease_end())
                    part, current, start, continues = in_part, None, None, False
                if order == 0:
                    start, continues = given or start, continues or goes_on
                    continue
                if current is None:
                    memory, lease = IdMemory(), 0
                    if start is not None:
                        memory, lease, last_us = json.loads(start)
                        memory, current = unpacked(memory), sender
                if current is not None and sender != current:
                    found.append(lease_end())
                    memory, lease = IdMemory(), 0
                elif current is not None and us - last_us >= rules.idle_us:
                    found.append(lease_end())
                    memory, lease = IdMemory(), lease + 1
                holes = observe(memory, msg_id, rules.capacity, rules.max_hole)
                current, last_us = sender, us
                if every or holes:
                    row = [*sender, msg_id, us, seq, "arrival", lease, memory.epoch, holes]
                    found.append(row)
            yield _frame(found, TRACKED)
        if current is not None and not continues:
            yield _frame([lease_end()], TRACKED)

    return run


def describe_partitions(pinned: DataFrame, rules: Rules) -> DataFrame:
    """One or two rows per partition of the pinned layout, numbered by ``place`` within a sender."""
    described = pinned.mapInPandas(describe(rules), _ddl(DESCRIBED))
    in_order = Window.partitionBy(*SENDER).orderBy("part")
    goes_on = (F.col("role") != "head") & F.lead("part").over(in_order).isNotNull()
    place = (F.row_number().over(in_order) - 1).cast("bigint")
    return cut_lineage(described.select("*", place.alias("place"), goes_on.alias("continues")))


def scan_ids(
    ids: DataFrame, idle: str, capacity: int, max_hole: int, every_arrival: bool = True
) -> DataFrame:
    """Every arrival with its lease, epoch and the hole it pushed out (``kind`` is
    ``arrival``), and every end of a lease with the holes left then (``lease_end``).
    Without ``every_arrival`` only the arrivals that pushed out a hole."""
    if capacity < 1:
        raise ValueError(f"a memory holds at least one id, not {capacity}")
    rules = Rules(duration_us(idle), capacity, max_hole, JUMPS)
    narrow = ids.select(*SENDER, "msg_id", *ARRIVAL)
    pinned = sorted_runs(narrow, SENDER, ARRIVAL).withColumn("us", F.unix_micros("ts")).drop("ts")
    while True:
        described = describe_partitions(pinned, rules)
        parts, most = described.agg(F.max("part") + 1, F.max("place") + 1).first()
        starts = cut_lineage(starting_memories(described.select(*FOLDED), most or 0, rules))
        if starts.where("not known").isEmpty():
            break
        rules.limit *= FOLD
    same = F.col("d.place") == F.col("s.place")
    for name in SENDER:
        same = same & F.col(f"d.{name}").eqNullSafe(F.col(f"s.{name}"))
    opening = described.alias("d").join(starts.alias("s"), same).select(
        *[f"d.{name}" for name in SENDER], "d.part", *[F.lit(0).alias(c) for c in ("order", "msg_id", "us", "seq")],
        "s.start", "d.continues",
    )
    rows = pinned.withColumn("order", F.lit(1)).unionByName(opening, allowMissingColumns=True)
    placed = rows.repartitionById(parts or 1, F.col("part")).sortWithinPartitions("part", "order", *SENDER, "us", "seq")
    tracked = placed.mapInPandas(track(rules, every_arrival), _ddl(TRACKED))
    return tracked.withColumn("ts", F.timestamp_micros("us")).select(
        *SENDER, "msg_id", *ARRIVAL, "kind", "lease", "epoch", "holes"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
