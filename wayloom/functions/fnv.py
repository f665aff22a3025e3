"""The 64-bit FNV-1a hash as column expressions. A hash is two halves of 32 bits, so that no product leaves 64 bits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: offset basis and prime (2^40 + 435)
_HIGH, _LOW, _PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
_MASK = 0xFFFFFFFF


def _step(s: Column, byte: Column) -> Column:
    low = s.low.bitwiseXOR(byte)
    product = low * _PRIME_LOW
    high = s.high * _PRIME_LOW + F.shiftrightunsigned(product, 32) + low.bitwiseAND(0xFFFFFF) * 256
    return F.struct(high.bitwiseAND(_MASK).alias("high"), product.bitwiseAND(_MASK).alias("low"))


def hashed(bytes_: Column) -> Column:
    """16 hex digits of an array of byte values (longs); null for null."""
    start = F.struct(F.lit(_HIGH).cast("long").alias("high"), F.lit(_LOW).cast("long").alias("low"))
    return F.aggregate(bytes_, start, _step, lambda s: F.lower(F.concat(F.lpad(F.hex(s.high), 8, "0"), F.lpad(F.hex(s.low), 8, "0"))))


def _bytes(digits: Column) -> Column:
    """Byte values of hex digits, in one pass over them (a substring by place would count from the start each time)."""
    return F.transform(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), lambda d: F.conv(d, 16, 10).cast("long"))


def fnv1a64(text: Column) -> Column:
    """The hash of a string's UTF-8 bytes or of a binary."""
    return F.when(text.isNotNull(), hashed(_bytes(F.hex(text))))


def set_hash(hashes: Column) -> Column:
    """The hash of a set of hashes (16 hex digits each): their numbers in ascending order, once each, as little-endian bytes."""
    sorted_ = F.array_sort(F.array_distinct(hashes))
    turned = F.transform(sorted_, lambda h: F.concat(*(F.substring(h, 15 - 2 * k, 2) for k in range(8))))
    return hashed(_bytes(F.array_join(turned, "")))
