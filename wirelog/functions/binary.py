"""Byte-level column functions. Positions are zero-based byte offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 0xFFFFFFFF


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def slice_bytes(data: Column | str, start, length) -> Column:
    """``length`` bytes from offset ``start``; both may be ints or columns."""
    begin = F.lit(start + 1) if isinstance(start, int) else start + 1
    size = F.lit(length) if isinstance(length, int) else length
    return F.substring(as_column(data), begin.cast("int"), size.cast("int"))


def unsigned(data: Column | str, start: int, width: int) -> Column:
    """Big-endian unsigned integer as bigint; NULL where the bytes are missing."""
    return F.conv(F.hex(slice_bytes(data, start, width)), 16, 10).cast("bigint")


def u8(data: Column | str, start: int) -> Column:
    return unsigned(data, start, 1).cast("int")


def u16(data: Column | str, start: int) -> Column:
    return unsigned(data, start, 2).cast("int")


def to_int32(value: Column) -> Column:
    """Reinterpret an unsigned 32-bit bigint as a signed int."""
    return F.when(value >= 2**31, value - 2**32).otherwise(value).cast("int")


def i32(data: Column | str, start: int) -> Column:
    return to_int32(unsigned(data, start, 4))


def hex_digits(value: Column, width: int) -> Column:
    """The low ``width`` bytes of an integer as big-endian hex digits."""
    mask = F.lit((1 << (8 * width)) - 1).cast("bigint")
    return F.lpad(F.hex(value.cast("bigint").bitwiseAND(mask)), 2 * width, "0")


def utf8_text(data: Column | str) -> Column:
    """Decode UTF-8; malformed sequences become U+FFFD instead of failing."""
    return F.make_valid_utf8(as_column(data).cast("string"))


def split_tags(buffer: Column | str) -> Column:
    """NUL-separated UTF-8 tags without the empty ones; no buffer gives an empty list."""
    parts = F.split(utf8_text(buffer), "\\x00")
    return F.coalesce(F.filter(parts, lambda tag: tag != ""), F.array().cast("array<string>"))


def join_tags(tags: Column | str) -> Column:
    """Inverse of :func:`split_tags`: tags as NUL-separated UTF-8 bytes."""
    joined = F.array_join(F.coalesce(as_column(tags), F.array().cast("array<string>")), "\0")
    return F.encode(joined, "UTF-8")


def latin1_bytes(text: Column | str) -> Column:
    """ISO-8859-1 bytes; every unmappable UTF-16 pair or character becomes one ``?``."""
    return F.encode(F.regexp_replace(as_column(text), "[^\\x00-\\xff]", "?"), "ISO-8859-1")


def reverse_bytes(data: Column | str) -> Column:
    pairs = F.regexp_extract_all(F.hex(as_column(data)), F.lit(".."), F.lit(0))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def log2_bucket(value: Column | str) -> Column:
    """Number of significant bits: 0, 1, 2-3, 4-7, ... map to 0, 1, 2, 3, ..."""
    number = as_column(value)
    return F.when(number == 0, F.lit(0)).otherwise(F.length(F.bin(number)))
