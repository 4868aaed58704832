"""Pluggable message handlers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wirelog.operators.messages import reverse_payload, truncate_payload


class Handler(Protocol):
    name: str

    def transform(self, messages: DataFrame) -> DataFrame: ...

    def stats(self) -> dict[str, Column] | None: ...


@dataclass
class Truncate:
    length: int
    name: str = "truncate"

    def transform(self, messages: DataFrame) -> DataFrame:
        return truncate_payload(messages, self.length)

    def stats(self) -> dict[str, Column]:
        return {"seen_messages": F.count(F.lit(1))}


@dataclass
class Reverse:
    name: str = "reverse"

    def transform(self, messages: DataFrame) -> DataFrame:
        return reverse_payload(messages)

    def stats(self) -> None:
        return None


@dataclass
class HandlerChain:
    """Result of :func:`apply_handlers`; ``stats()`` is known once ``messages`` was read."""

    messages: DataFrame
    observed: list[tuple[str, Observation | None]] = field(default_factory=list)

    def stats(self) -> list[dict]:
        return [
            {**(seen.get if seen else {}), "name": name} for name, seen in self.observed
        ]


def handlers_column(stats: list[dict]) -> Column:
    """What :meth:`HandlerChain.stats` or a sink reports, for ``stats_json``."""
    names = ["name", *sorted({name for one in stats for name in one} - {"name"})]
    kinds = {name: "string" if name == "name" else "bigint" for name in names}
    rows = [
        F.struct(*[F.lit(one.get(name)).cast(kinds[name]).alias(name) for name in names]) for one in stats
    ]
    shape = ", ".join(f"{name}: {kinds[name]}" for name in names)
    return F.array(*rows).cast(f"array<struct<{shape}>>")


def apply_handlers(messages: DataFrame, handlers: list[Handler]) -> HandlerChain:
    """Run handlers in order. Their statistics are observed on what enters each of them;
    a handler without any shows up with its name only."""
    observed: list[tuple[str, Observation | None]] = []
    for handler in handlers:
        measures = handler.stats()
        seen = None
        if measures:
            seen = Observation()
            messages = messages.observe(
                seen, *[column.alias(name) for name, column in measures.items()]
            )
        observed.append((handler.name, seen))
        messages = handler.transform(messages)
    return HandlerChain(messages, observed)
