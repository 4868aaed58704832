"""One message being reassembled, fragment by fragment: pure Python, for streams and for
the replica of the online behaviour."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark import cloudpickle


@dataclass
class PartialMessage:
    """The first fragment fixes the header; ``pieces`` holds the valid payload per index."""

    count: int
    size: int
    hash: int
    length: int
    first_us: int
    last_us: int
    tags: list | None = None
    done: bool = False
    pieces: dict = field(default_factory=dict)

    @classmethod
    def opened_by(cls, fragment) -> "PartialMessage":
        return cls(
            int(fragment.fragment_count),
            int(fragment.fragment_size),
            int(fragment.msg_hash),
            int(fragment.total_length),
            int(fragment.us),
            int(fragment.us),
        )

    def accepts(self, fragment) -> bool:
        index, size = int(fragment.fragment_index), int(fragment.fragment_size)
        same = (size, fragment.fragment_count, fragment.msg_hash) == (
            self.size,
            self.count,
            self.hash,
        )
        rest = self.length - size * index
        expected = rest if index == self.count - 1 else self.size
        return bool(same and len(fragment.payload) == expected)

    def ingest(self, fragment) -> str:
        """``late_duplicate``, ``invalid``, ``stored`` or, once, ``complete``."""
        self.last_us = max(self.last_us, int(fragment.us))
        if self.done:
            return "late_duplicate"
        if not self.accepts(fragment):
            return "invalid"
        if fragment.tags is not None:
            self.tags = list(fragment.tags)
        self.pieces[int(fragment.fragment_index)] = bytes(fragment.payload)
        self.done = len(self.pieces) == self.count
        return "complete" if self.done else "stored"

    def payload(self) -> bytes:
        return b"".join(self.pieces[index] for index in sorted(self.pieces))

    def missing(self) -> list[int]:
        return [index for index in range(self.count) if index not in self.pieces]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
