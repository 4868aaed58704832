"""MurmurHash3 (x86, 32 bit), Java string hashing and key-group partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.functions.binary import UINT32, as_column, slice_bytes, to_int32
from wirelog.schemas import DEFAULT_MAX_PARALLELISM

# Fixed values of the published MurmurHash3 x86_32 algorithm, then the modular
# inverses (mod 2^32) that undo its multiplications.
C1 = 0xCC9E2D51
C2 = 0x1B873593
MIX1 = 0x85EBCA6B
MIX2 = 0xC2B2AE35
BLOCK_ADD = 0xE6546B64
SPARK_HASH_SEED = 42


def _chain_seed(seed: int) -> int:
    """The int whose Spark ``hash`` equals ``seed``.

    ``hash(a, b)`` feeds the hash of ``a`` as the seed of ``b``, so hashing this literal
    first makes Spark's built-in start from any seed. Each mixing step is a bijection.
    """
    h = seed & UINT32
    h ^= h >> 16
    h = h * pow(MIX2, -1, 2**32) & UINT32
    h ^= (h >> 13) ^ (h >> 26)
    h = h * pow(MIX1, -1, 2**32) & UINT32
    h ^= h >> 16
    h ^= 4
    h = (h - BLOCK_ADD) * pow(5, -1, 2**32) & UINT32
    h = ((h >> 13) | (h << 19)) & UINT32
    k = h ^ SPARK_HASH_SEED
    k = k * pow(C2, -1, 2**32) & UINT32
    k = ((k >> 15) | (k << 17)) & UINT32
    k = k * pow(C1, -1, 2**32) & UINT32
    return k - 2**32 if k >= 2**31 else k


def _mul32(value: Column, factor: int) -> Column:
    low = value.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)
    high = F.shiftright(value, 16) * F.lit(factor)
    return (low + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(0x10000)).bitwiseAND(F.lit(UINT32))


def _xorshift(value: Column, bits: int) -> Column:
    return value.bitwiseXOR(F.shiftright(value, bits))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def murmur3_32(payload: Column | str, seed: int = 0) -> Column:
    """The standard 32-bit hash of a binary column as a signed int.

    Spark's ``hash`` agrees with the standard on whole 4-byte words but mixes the last
    1-3 bytes differently. So the built-in hashes the aligned prefix, its finalizer is
    undone, the tail is mixed in by the standard rule, and the finalizer runs again.
    Steps use their input several times; each is bound, so that the expression stays linear
    in size wherever the optimizer moves it.
    """
    data = as_column(payload)
    size = F.octet_length(data).cast("bigint")
    tail_start = size - size % 4

    def tail_byte(offset: int) -> Column:
        return F.hex(slice_bytes(data, tail_start + offset, 1))

    tail = F.conv(F.concat(tail_byte(2), tail_byte(1), tail_byte(0)), 16, 10).cast("bigint")
    mixed_tail = _in_steps(
        F.coalesce(tail, F.lit(0).cast("bigint")),
        lambda k: _mul32(k, C1),
        lambda k: F.shiftleft(k, 15).bitwiseOR(F.shiftright(k, 17)).bitwiseAND(F.lit(UINT32)),
        lambda k: _mul32(k, C2),
    )
    prefix_hash = F.hash(F.lit(_chain_seed(seed)), slice_bytes(data, 0, tail_start))
    return _in_steps(
        prefix_hash.cast("bigint").bitwiseAND(F.lit(UINT32)),
        lambda h: _xorshift(h, 16),
        lambda h: _mul32(h, pow(MIX2, -1, 2**32)),
        lambda h: h.bitwiseXOR(F.shiftright(h, 13)).bitwiseXOR(F.shiftright(h, 26)),
        lambda h: _mul32(h, pow(MIX1, -1, 2**32)),
        lambda h: _xorshift(h, 16).bitwiseXOR(tail_start).bitwiseXOR(mixed_tail).bitwiseXOR(size),
        lambda h: _xorshift(h, 16),
        lambda h: _mul32(h, MIX1),
        lambda h: _xorshift(h, 13),
        lambda h: _mul32(h, MIX2),
        lambda h: _xorshift(h, 16),
        to_int32,
    )


def _in_steps(value: Column, *steps: Callable[[Column], Column]) -> Column:
    for step in steps:
        value = _bind(value, step)
    return value


def with_murmur3(df: DataFrame, payload: str, out: str, seed: int = 0) -> DataFrame:
    return df.withColumn(out, murmur3_32(payload, seed))


def java_string_hash(key: Column | str) -> Column:
    """``String.hashCode``: base-31 polynomial over UTF-16 units, wrapped to a signed int."""

    def add(acc: Column, unit: Column) -> Column:
        return (acc * 31 + unit).bitwiseAND(F.lit(UINT32))

    def add_character(acc: Column, character: Column) -> Column:
        code = F.ascii(character).cast("bigint")  # the whole code point
        above = code - 0x10000
        high = F.shiftright(above, 10) + 0xD800
        low = above.bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(above < 0, add(acc, code)).otherwise(add(add(acc, high), low))

    characters = F.split(as_column(key), "")
    return to_int32(F.aggregate(characters, F.lit(0).cast("bigint"), add_character))


def key_group_partition(
    key: Column | str, num_partitions: int, max_parallelism: int = DEFAULT_MAX_PARALLELISM
) -> Column:
    """Partition of a string key: key group by hash, then groups spread evenly.

    NULL keys give NULL, which leaves the choice to the producer.
    """
    if num_partitions < 1 or max_parallelism < 1:
        raise ValueError("partitions and parallelism must be positive")
    mixed = F.hash(F.lit(_chain_seed(0)), java_string_hash(key)).cast("bigint")
    positive = F.when(mixed == -(2**31), F.lit(0)).otherwise(F.abs(mixed))
    group = positive % max_parallelism
    partition = F.call_function("div", group * num_partitions, F.lit(max_parallelism))
    return F.when(as_column(key).isNotNull(), partition.cast("int"))


def spread_null_keys(key: Column | str, partition: Column, identity: list, n: int) -> Column:
    """A reproducible spread for rows without key; keyed rows keep ``partition``."""
    spread = F.pmod(F.xxhash64(*identity), F.lit(n)).cast("int")
    return F.when(as_column(key).isNull(), spread).otherwise(partition)
