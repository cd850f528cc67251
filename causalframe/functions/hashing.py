"""Positions on the ring and digests of sets of versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_SIZE = 1 << 32


def position(key: Column) -> Column:
    """The first four bytes of the key's MD5 as an unsigned number."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def leaf(key: Column, value: Column) -> Column:
    """SHA-256 of key and value, one behind the other, in hex."""
    return F.sha2(F.concat(key.cast("binary"), value.cast("binary")), 256)
