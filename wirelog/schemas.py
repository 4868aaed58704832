"""Column layouts of the logical tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

SENDER = ["listener", "sender_host", "sender_port"]
ARRIVAL = ["ts", "seq"]

PACKETS = T.StructType(
    [
        T.StructField("listener", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("sender_host", T.StringType()),
        T.StructField("sender_port", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)

HEADER_FIELDS = [
    "msg_id",
    "fragment_count",
    "fragment_index",
    "fragment_size",
    "total_length",
    "msg_hash",
]

MESSAGE_COLUMNS = [
    "listener",
    "transport",
    "ts",
    "sender_host",
    "sender_port",
    "msg_id",
    "fragment_count",
    "tags",
    "payload",
]

EVENT_JSON = "type string, uuid string, host string, timestamp bigint, data variant"

# Fixed values of the wire format and of the defaults that results depend on.
HEADER_SIZE = 24
MAX_UDP_PAYLOAD = 65507
DEFAULT_RECEIVE_SIZE = 65536
DEFAULT_MAX_LINE = 1048576
DEFAULT_CHUNK_SIZE = 64000
DEFAULT_EXPIRE = "10 seconds"
DEFAULT_IDLE = "1 minute"
DEFAULT_IDS_PER_PORT = 10
DEFAULT_MAX_HOLE = 10
DEFAULT_MAX_PARALLELISM = 16386
KNOWN_COMMANDS = ["KILL", "PING", "STAT", "ENVI"]

# How far behind the newest packet a packet may arrive in a stream. Spark drops what comes
# later, and with no tolerance also what shares its instant with the end of a micro-batch.
DEFAULT_DISORDER = "1 second"
