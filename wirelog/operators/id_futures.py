"""What a stretch of ids does to every memory it may meet, and how stretches compose: pure Python."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field

from pyspark import cloudpickle

from wirelog.operators.id_state import NEVER_STORED, IdMemory, observe


@dataclass
class Jump:
    """An id at which a memory coming in may jump for the first time."""

    candidate: int
    upwards: bool
    opens: bool  # the stretch begins here, so only the memory coming in has bounds
    group: int


@dataclass
class Beyond:
    """Jumps that are not listed: the lowest id of those down and the highest of those up."""

    down: int | None = None
    up: int | None = None

    def add(self, candidate: int, upwards: bool) -> None:
        if upwards:
            self.up = candidate if self.up is None else max(self.up, candidate)
        else:
            self.down = candidate if self.down is None else min(self.down, candidate)

    def __bool__(self) -> bool:
        return self.down is not None or self.up is not None

    def takes(self, memory: IdMemory, max_hole: int) -> bool:
        """Bounds that are unset are set by the stretch before these jumps come, so they jump."""
        up = self.up is not None and (memory.hi is None or self.up - memory.hi > max_hole)
        return up or (self.down is not None and (memory.lo is None or memory.lo - self.down > max_hole))


class Futures:
    """Follows a stretch for an unknown memory coming in.

    Without a jump that memory just grows. Its first jump can only happen at an id outside
    the range of all earlier ids of the stretch by more than ``max_hole``, and from there on
    nothing depends on what came in. At such an id every followed memory with known bounds
    jumps as well, so they fall together: no more than three ever differ.

    With ``limit`` no more than that many jumps are listed. Of the others the lowest and the
    highest id is kept, which tells whether a memory makes one of them, but not where it leads.
    """

    def __init__(self, capacity: int, max_hole: int, limit: int | None = None):
        self.capacity, self.max_hole, self.limit = capacity, max_hole, limit
        self.beyond = Beyond()
        self.grown = IdMemory()
        self.jumps: list[Jump] = []
        self.members: list[IdMemory | None] = [IdMemory()]  # 0: nothing came in
        self.joined: list[tuple[int, int] | None] = [None]  # (group, epochs ahead of it)
        self.live = [0]

    def add(self, candidate: int) -> None:
        grown = self.grown
        opens = grown.lo is None
        for group in self.live:
            observe(self.members[group], candidate, self.capacity, self.max_hole)
        if opens or grown.jumps(candidate, self.max_hole):
            for upwards in (True, False) if opens else (candidate > grown.hi,):
                if self.limit is not None and len(self.jumps) >= self.limit:
                    self.beyond.add(candidate, upwards)
                    continue
                recent = [] if candidate == NEVER_STORED else [candidate]
                self.jumps.append(Jump(candidate, upwards, opens, len(self.members)))
                self.live.append(len(self.members))
                self.members.append(IdMemory(None, None if upwards else candidate, recent, 1))
                self.joined.append(None)
        if len(self.live) > 1:
            self._join_equal()
        observe(IdMemory(recent=grown.recent), candidate, self.capacity, 1)
        grown.lo = candidate if opens else min(grown.lo, candidate)
        grown.hi = candidate if opens else max(grown.hi, candidate)

    def _join_equal(self) -> None:
        kept: list[int] = []
        for group in self.live:
            memory = self.members[group]
            twin = next((k for k in kept if self.members[k].same_future(memory)), None)
            if twin is None:
                kept.append(group)
            else:
                self.joined[group] = (twin, memory.epoch - self.members[twin].epoch)
                self.members[group] = None
        self.live = kept

    def outcome(self, group: int) -> tuple[int, int]:
        """(index in ``live``, epochs begun since the group's start, its jump included)."""
        ahead = 0
        while self.joined[group] is not None:
            group, step = self.joined[group]
            ahead += step
        return self.live.index(group), ahead + self.members[group].epoch


def first_jump(memory: IdMemory, jumps: list[tuple[int, bool, bool]], max_hole: int) -> int | None:
    """Position of the jump that ``memory`` makes first; ``jumps`` are (id, upwards, opens)."""
    for position, (candidate, upwards, opens) in enumerate(jumps):
        bound = memory.hi if upwards else memory.lo
        if bound is None:
            if not opens:
                return position
        elif (candidate - bound if upwards else bound - candidate) > max_hole:
            return position
    return None


def grow(memory: IdMemory, grown: IdMemory, capacity: int) -> IdMemory:
    """``memory`` after a stretch without a jump, whose own ids make ``grown``."""
    return IdMemory(
        grown.lo if memory.lo is None else min(memory.lo, grown.lo),
        grown.hi if memory.hi is None else max(memory.hi, grown.hi),
        sorted({*memory.recent, *grown.recent})[-capacity:],
        memory.epoch,
    )


@dataclass
class Rules:
    """Settings of the detector; ``limit`` is how many jumps a description lists."""

    idle_us: int
    capacity: int
    max_hole: int
    limit: int


@dataclass
class Stretch:
    """What consecutive arrivals of one sender do: of constant size, whatever their number.

    ``ends`` are memories that the stretch may end with; None is one that is not known because
    the way there leads over a jump that is not listed. ``fresh`` and ``jumps`` name an end and the
    epochs begun on the way. Without ``grown`` a lease ends inside, so what comes in has no effect.
    """

    first_us: int
    last_us: int
    leases: int
    fresh: tuple[int, int]
    ends: list[IdMemory | None]
    jumps: list[tuple[int, bool, bool, int, int]] = field(default_factory=list)
    grown: IdMemory | None = None
    beyond: Beyond = field(default_factory=Beyond)

    @staticmethod
    def constant(first_us: int, last_us: int, leases: int, memory: IdMemory | None) -> "Stretch":
        return Stretch(first_us, last_us, leases, (0, memory.epoch if memory else 0), [memory])

    @staticmethod
    def of(futures: Futures, first_us: int, last_us: int) -> "Stretch":
        jumps = [(j.candidate, j.upwards, j.opens, *futures.outcome(j.group)) for j in futures.jumps]
        ends = [futures.members[group] for group in futures.live]
        return Stretch(first_us, last_us, 0, futures.outcome(0), ends, jumps, futures.grown, futures.beyond)

    def after(self, memory: IdMemory | None, rules: Rules) -> IdMemory | None:
        """The memory after the stretch (None: not known); ``memory`` None is that of a new lease."""
        begun = 0
        if memory is None or self.grown is None:
            end, epochs = self.fresh
        else:
            position = first_jump(memory, [jump[:3] for jump in self.jumps], rules.max_hole)
            if position is None:
                if self.beyond.takes(memory, rules.max_hole):
                    return None
                return grow(memory, self.grown, rules.capacity)
            end, epochs = self.jumps[position][3:]
            begun = memory.epoch
        found = self.ends[end]
        return None if found is None else IdMemory(found.lo, found.hi, list(found.recent), begun + epochs)

    def breaks(self, last_us: int, rules: Rules) -> bool:
        return self.first_us - last_us >= rules.idle_us

    def followed_by(self, other: "Stretch", rules: Rules) -> "Stretch":
        """Both in one. Associative: however a run of stretches is folded, it does the same."""
        broke = other.breaks(self.last_us, rules)
        leases = self.leases + broke + other.leases
        if broke or other.grown is None:
            return Stretch.constant(self.first_us, other.last_us, leases, other.after(None, rules))
        if self.grown is None:
            known = self.after(None, rules)
            return Stretch.constant(self.first_us, other.last_us, leases, known and other.after(known, rules))
        ends: list[IdMemory | None] = []

        def led_to(memory: IdMemory | None) -> int:
            for place, known in enumerate(ends):
                if known is memory is None or (known and memory and known.same_future(memory)):
                    return place
            ends.append(memory)
            return len(ends) - 1

        def through(end: int, epochs: int) -> tuple[int, int]:
            start = self.ends[end]
            after = start and other.after(IdMemory(start.lo, start.hi, list(start.recent), epochs), rules)
            return led_to(after), after.epoch if after else 0

        fresh = through(*self.fresh)
        jumps = [(*jump[:3], *through(*jump[3:])) for jump in self.jumps]
        beyond = Beyond(self.beyond.down, self.beyond.up)

        def reached(candidate: int, upwards: bool) -> bool:
            """Whether a memory that has grown over this stretch can still jump there."""
            gap = candidate - self.grown.hi if upwards else self.grown.lo - candidate
            return gap > rules.max_hole

        for candidate, upwards, _, end, epochs in other.jumps:
            if reached(candidate, upwards):
                if beyond or len(jumps) >= rules.limit:
                    beyond.add(candidate, upwards)
                else:
                    jumps.append((candidate, upwards, False, led_to(other.ends[end]), epochs))
        for candidate, upwards in ((other.beyond.down, False), (other.beyond.up, True)):
            if candidate is not None and reached(candidate, upwards):
                beyond.add(candidate, upwards)
        grown = grow(self.grown, other.grown, rules.capacity)
        return Stretch(self.first_us, other.last_us, leases, fresh, ends, jumps, grown, beyond)

    def to_json(self) -> str:
        ends = [m and packed(m) for m in self.ends]
        grown = self.grown and packed(self.grown)
        beyond = [self.beyond.down, self.beyond.up]
        return json.dumps([self.first_us, self.last_us, self.leases, self.fresh, ends, self.jumps, grown, beyond])

    @staticmethod
    def from_json(text: str) -> "Stretch":
        first_us, last_us, leases, fresh, ends, jumps, grown, beyond = json.loads(text)
        ends = [m and unpacked(m) for m in ends]
        jumps = [tuple(jump) for jump in jumps]
        return Stretch(first_us, last_us, leases, tuple(fresh), ends, jumps, grown and unpacked(grown), Beyond(*beyond))


def packed(memory: IdMemory) -> list:
    return [memory.lo, memory.hi, memory.recent, memory.epoch]


def unpacked(values: list) -> IdMemory:
    return IdMemory(*values)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
