"""Importing this module registers every query."""

from catalog import (  # noqa: F401
    hole_queries,
    message_queries,
    packet_queries,
    reassembly_queries,
    stats_queries,
    stream_queries,
)
from catalog.registry import ORACLES, QUERIES  # noqa: F401
