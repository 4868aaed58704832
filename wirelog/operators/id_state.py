"""The bounded memory of one sender's message ids: pure Python, shared by batch and stream."""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark import cloudpickle

NEVER_STORED = -(2**31)


@dataclass
class IdMemory:
    """``lo``/``hi`` bound the ids of this epoch (None: unset); ``recent`` holds the largest
    distinct ones in order; ``epoch`` counts how often everything was forgotten."""

    lo: int | None = None
    hi: int | None = None
    recent: list = field(default_factory=list)
    epoch: int = 0

    def copy(self) -> "IdMemory":
        return IdMemory(self.lo, self.hi, list(self.recent), self.epoch)

    def same_future(self, other: "IdMemory") -> bool:
        return (self.lo, self.hi, self.recent) == (other.lo, other.hi, other.recent)

    def forget(self) -> None:
        self.lo, self.hi, self.recent = None, None, []
        self.epoch += 1

    def jumps(self, candidate: int, max_hole: int) -> bool:
        below = self.lo is not None and self.lo - candidate > max_hole
        above = self.hi is not None and candidate - self.hi > max_hole
        return below or above


def observe(memory: IdMemory, candidate: int, capacity: int, max_hole: int) -> int:
    """Take in one id; returns the size of the hole that its insertion pushed out.

    A jump of more than ``max_hole`` outside the known range means that the sender's port
    was reused. After a jump down the new id counts as the maximum; after a jump up it
    leaves both bounds unset.
    """
    if memory.jumps(candidate, max_hole):
        downwards = memory.lo is not None and candidate < memory.lo
        memory.forget()
        if downwards:
            memory.hi = candidate
    else:
        memory.lo = candidate if memory.lo is None else min(memory.lo, candidate)
        memory.hi = candidate if memory.hi is None else max(memory.hi, candidate)
    recent = memory.recent
    place = bisect_left(recent, candidate)
    known = place < len(recent) and recent[place] == candidate
    if candidate == NEVER_STORED or known:
        return 0
    if len(recent) == capacity and place == 0:
        pushed_out = candidate
    else:
        insort(recent, candidate)
        if len(recent) <= capacity:
            return 0
        pushed_out = recent.pop(0)
    hole = recent[0] - pushed_out - 1
    return hole if 0 < hole <= max_hole else 0


def remaining_holes(memory: IdMemory, max_hole: int) -> int:
    """Holes still inside the memory when its sender goes idle."""
    sizes = (b - a - 1 for a, b in zip(memory.recent, memory.recent[1:]))
    return sum(size for size in sizes if 0 < size <= max_hole)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
