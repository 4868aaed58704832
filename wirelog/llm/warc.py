"""WARC archives: a writer, and a reader that splits gzip files by byte ranges.

The writer puts one record per gzip member, so an archive can be entered at any member. The
reader deals byte ranges of the files to tasks. A task looks for the gzip magic from the start
of its range, accepts a place only if a member decodes from there into a WARC header and ends
where another member or the file ends, owns the records that start inside its range, and reads
past its end to finish the last one. Every record is thus read once, whatever the split size.

Archives are written and read through pyarrow's file systems (local, HDFS, S3, GCS); a shared folder
of another kind can't hold them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelog.llm.frames import Scratch, named

SPLIT_BYTES = 32 << 20
ARCHIVE_BYTES = 256 << 20
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 16
_SCHEMA = "record_id string, record_type string, uri string, refers_to string, digest string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str, refers_to: str | None, digest: str, payload: bytes) -> bytes:
    """One record as a gzip member; the same input gives the same bytes."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_one_line(uri)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(payload)}")
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (columns of the reader) below ``folder``; gives ``path``, ``length``, ``records``.

    A partition becomes one archive, or several of about ``ARCHIVE_BYTES``. The names follow
    from the partition, and a file appears under its name only when complete, so a task that
    is run again replaces what its predecessor left. ``folder`` is a URI that executors reach.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, done, stream, size, count = 0, [], None, 0, 0

        def finish():
            nonlocal stream
            stream.close()
            store.move(*names)
            done.append((names[1], size, count))
            stream = None

        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    final = f"{root}/part-{context.partitionId():06d}-{part:04d}.warc.gz"
                    names = (f"{final}.{context.taskAttemptId()}.tmp", final)
                    stream, size, count, part = store.open_output_stream(names[0]), 0, 0, part + 1
                member = record_bytes(
                    row["record_type"], row["record_id"], row["uri"] or "", row["refers_to"], row["digest"],
                    row["payload"] or b"",
                )
                stream.write(member)
                size, count = size + len(member), count + 1
                if size >= ARCHIVE_BYTES:
                    finish()
        if stream is not None:
            finish()
        yield pa.RecordBatch.from_pylist(
            [{"path": p, "length": n, "records": c} for p, n, c in done],
            pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())]),
        )

    return records.select("record_id", "record_type", "uri", "refers_to", "digest", "payload").mapInArrow(
        write, "path string, length bigint, records bigint"
    )


class _Source:
    """Bytes of a file from a place on, read in pieces and kept only while needed."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.held = file, at, size, b""

    def have(self, at: int, count: int) -> bytes:
        """Up to ``count`` bytes at ``at``; earlier bytes are given up."""
        if at > self.at:
            self.held = self.held[at - self.at :] if at - self.at < len(self.held) else b""
            self.at = at
        while len(self.held) < count and self.at + len(self.held) < self.size:
            self.file.seek(self.at + len(self.held))
            self.held += self.file.read(max(_READ, count - len(self.held)))
        return self.held[:count]


def _member(file, at: int, size: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``; nothing if none with a WARC header is there."""
    unpacker, content, checked, place = zlib.decompressobj(31), [], False, at
    begin, tail = b"", b""
    while not unpacker.eof:
        file.seek(place)
        data = file.read(_READ)
        if not data:
            return None
        try:
            piece = unpacker.decompress(data)
        except zlib.error:
            return None
        place += len(data)
        content.append(piece)
        if not checked:
            begin = (begin + piece[:5])[:5]
            if begin != b"WARC/"[: len(begin)]:
                return None
            checked = b"\r\n\r\n" in tail + piece
            tail = (tail + piece)[-3:]
    return (b"".join(content), place - len(unpacker.unused_data)) if checked else None


def _starts_member(file, at: int, size: int) -> bool:
    """Whether ``at`` is the end of the file or a gzip member that begins like a WARC record."""
    if at >= size:
        return at == size
    file.seek(at)
    try:
        return zlib.decompressobj(31).decompress(file.read(_READ), 5) == b"WARC/"
    except zlib.error:
        return False


def parse_record(content: bytes) -> dict | None:
    """Fields of one record; nothing if its header is no WARC header or its block is cut off."""
    head, gap, block = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not gap or not length.isdigit() or len(block) < int(length):
        return None
    refers = fields.get(b"warc-refers-to")
    return {
        "record_id": fields.get(b"warc-record-id", "").strip("<>"),
        "record_type": fields.get(b"warc-type"),
        "uri": fields.get(b"warc-target-uri"),
        "refers_to": refers.strip("<>") if refers else None,
        "digest": fields.get(b"warc-payload-digest", "").removeprefix("sha1:"),
        "payload": block[: int(length)],
    }


def records_in(file, size: int, start: int, end: int) -> Iterator[dict]:
    """Records whose member begins in ``[start, end)``."""
    source, at, chained = _Source(file, start, size), start, False
    while at < end:
        if not chained:
            data = source.have(at, min(_READ, end - at + len(_MAGIC) - 1))
            found = data.find(_MAGIC)
            if found < 0:
                at += max(1, len(data) - len(_MAGIC) + 1)
                continue
            at += found
            if at >= end:
                return
        member = _member(file, at, size)
        record = parse_record(member[0]) if member else None
        if record and (chained or _starts_member(file, member[1], size)):
            yield record
            at, chained = member[1], _starts_member(file, member[1], size)
        else:
            at, chained = at + 1, False


def _reader(uri: str):
    schema = pa.schema(
        [(n, pa.string()) for n in ("record_id", "record_type", "uri", "refers_to", "digest")]
        + [("payload", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for split in batch.to_pylist():
                held, size = [], 0
                with store.open_input_file(split["path"]) as file:
                    for record in records_in(file, split["length"], split["start"], split["end"]):
                        held.append(record)
                        size += len(record["payload"])
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return read


def read_archives(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of ``files`` (``path`` in the store of ``folder``, ``length``).

    Bytes between members that are no record are passed over; an empty table gives no record.
    """
    splits = files.where("length > 0").select(
        "path", "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"),
    ).withColumn("end", F.least(F.col("start") + split_bytes, F.col("length")))
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return splits.repartition(spread, "path", "start").mapInArrow(_reader(folder), _SCHEMA)


def archive_pages(
    pages: DataFrame, scratch: Scratch | None = None, id_column: str = "page_id", uri_column: str = "url",
    payload_column: str = "html", least_bytes: int = 0, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages``, read the archives back, and describe each record.

    Of equal payloads of at least ``least_bytes`` bytes the one with the largest id is a
    response with the payload, the others are revisits that name it; smaller ones are all
    responses. Rows tied at the largest id are all responses. A null payload is empty, a null
    uri is empty, a null id is below every other and refers to nothing it does not share.
    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    kind = pages.select(named(id_column)).schema[0].dataType.simpleString()
    rows = pages.select(
        named(id_column).alias("page_id"),
        named(uri_column).alias("uri"),
        F.encode(F.coalesce(named(payload_column), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    largest = rows.groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    # Stored, so that the join below reads it as a table of its own and a frequent payload can be split.
    largest = scratch.store(largest, "largest")
    revisit = (
        F.col("largest").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("largest"))
        & (F.octet_length("payload") >= least_bytes)
    )
    record_id = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    records = rows.join(largest, "sha", "left").select(
        record_id("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "uri",
        F.when(revisit, record_id("largest")).alias("refers_to"),
        _base32(F.col("sha")).alias("digest"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    folder = scratch.path("archives")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    files = scratch.store(write_archives(records, folder), "files")
    read = read_archives(spark, files, folder, split_bytes)
    described = scratch.store(
        read.mapInArrow(_measure, "record_id string, record_type string, refers_to string, digest string, payload_bytes bigint"),
        "described",
    )
    full = described.where("record_type = 'response'").groupBy("record_id", "digest").agg(
        F.first("payload_bytes").alias("full_bytes")
    )
    full = scratch.store(full, "full")
    page = lambda c: F.nullif(F.substring(c, len("urn:page:") + 1, 1 << 20), F.lit("")).cast(kind)
    back = described.join(
        full.select(F.col("record_id").alias("refers_to"), "digest", "full_bytes"), ["refers_to", "digest"], "left"
    )
    return back.select(
        page("record_id").alias("page_id"),
        F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and digests of what was read; a response's digest is computed from its payload."""
    for batch in batches:
        payloads = batch.column("payload").to_pylist()
        types = batch.column("record_type").to_pylist()
        digests = [
            digest_of(p) if t == "response" else d
            for p, t, d in zip(payloads, types, batch.column("digest").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("record_id"), batch.column("record_type"), batch.column("refers_to"),
                pa.array(digests, pa.string()), pa.array([len(p) for p in payloads], pa.int64()),
            ],
            names=["record_id", "record_type", "refers_to", "digest", "payload_bytes"],
        )


def _base32(hexadecimal):
    """Base32 of forty hexadecimal digits: eight five-bit letters for every ten digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for group in range(4):
        number = F.conv(F.substring(hexadecimal, group * 10 + 1, 10), 16, 10).cast("long")
        for place in range(8):
            digit = F.shiftright(number, 35 - 5 * place).bitwiseAND(F.lit(31)).cast("int")
            parts.append(F.substring(letters, digit + 1, F.lit(1)))
    return F.concat(*parts)
