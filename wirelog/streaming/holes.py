"""Online hole detection as a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wirelog.operators.id_state import IdMemory, observe, remaining_holes
from wirelog.schemas import (
    DEFAULT_DISORDER,
    DEFAULT_IDLE,
    DEFAULT_IDS_PER_PORT,
    DEFAULT_MAX_HOLE,
    SENDER,
)
from wirelog.session import duration_us

STATE = "lo bigint, hi bigint, recent array<bigint>, epoch int, last_us bigint"
OUTPUT = (
    "listener string, sender_host string, sender_port int, msg_id bigint, us bigint, "
    "kind string, epoch int, holes int"
)
NAMES = [column.split()[0] for column in OUTPUT.split(", ")]


def _load(state: GroupState) -> tuple[IdMemory, int | None]:
    if not state.exists:
        return IdMemory(), None
    lo, hi, recent, epoch, last_us = state.get
    bounds = (None if bound is None or pd.isna(bound) else int(bound) for bound in (lo, hi))
    return IdMemory(*bounds, [int(x) for x in recent], int(epoch)), int(last_us)


def _step(idle_us: int, capacity: int, max_hole: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, last_us = _load(state)
        found = []

        def lease_end() -> None:
            holes = remaining_holes(memory, max_hole)
            if holes:
                found.append([*key, None, last_us, "lease_end", memory.epoch, holes])

        if state.hasTimedOut:
            lease_end()
            state.remove()
        else:
            arrivals = pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable")
            for msg_id, us in zip(arrivals["msg_id"].tolist(), arrivals["us"].tolist()):
                if last_us is not None and us - last_us >= idle_us:
                    lease_end()
                    memory = IdMemory()
                holes = observe(memory, msg_id, capacity, max_hole)
                last_us = us
                if holes:
                    found.append([*key, msg_id, us, "arrival", memory.epoch, holes])
            state.update((memory.lo, memory.hi, memory.recent, memory.epoch, last_us))
            deadline = (last_us + idle_us) // 1000
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=NAMES, dtype=object)

    return run


def holes_stream(
    ids: DataFrame,
    idle: str = DEFAULT_IDLE,
    ids_per_port: int = DEFAULT_IDS_PER_PORT,
    max_hole: int = DEFAULT_MAX_HOLE,
    watermark_delay: str = DEFAULT_DISORDER,
) -> DataFrame:
    """Holes pushed out by arrivals (``arrival``) and left at the end of a lease
    (``lease_end``), as they are found."""
    if max_hole < 1 or ids_per_port < 1:
        raise ValueError("max_hole and ids_per_port must be positive")
    return (
        ids.withWatermark("ts", watermark_delay)
        .select(*SENDER, "msg_id", "ts", "seq", F.unix_micros("ts").alias("us"))
        .groupBy(*SENDER)
        .applyInPandasWithState(
            _step(duration_us(idle), ids_per_port, max_hole),
            OUTPUT,
            STATE,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
