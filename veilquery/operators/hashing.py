"""Keyed hashes of selector values, as native columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def selector_text(c: Column) -> Column:
    """The text form under which selector values are matched; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def keyed_hash(key: str, bits: int, text: Column) -> Column:
    """First four bytes of MD5(key + text), big-endian, masked to ``bits`` (a signed int at 32)."""
    first = F.conv(F.substring(F.md5(F.concat(F.lit(key), text).cast("binary")), 1, 8), 16, 10).cast("bigint")
    if bits < 32:
        return first.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return F.when(first >= 1 << 31, first - (1 << 32)).otherwise(first).cast("int")


def row_hash(key: str, bits: int, selector: Column) -> Column:
    return keyed_hash(key, bits, selector_text(selector))


def aux_hash(selector: Column) -> Column:
    """The hash that is embedded in a record to tell its selector from others of the bucket."""
    return keyed_hash("aux", 32, selector_text(selector))


def keyed_hash_of(key: str, bits: int, text: str) -> int:
    """The same hash of one string, for the few selectors of a query."""
    first = int.from_bytes(hashlib.md5((key + text).encode()).digest()[:4], "big")
    return first & ((1 << bits) - 1) if bits < 32 else first - (1 << 32) * (first >= 1 << 31)
