"""Key order, prefixes, cursors and record visibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
CURSOR = b"\x01"


def prefix_upper_bound(prefix: bytes) -> bytes | None:
    """The smallest key above every key with this prefix; None if there is none (empty, or FF throughout)."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def in_prefix(key: Column, prefix: str) -> Column:
    """As a half-open range, which reaches a Parquet scan; an ASCII prefix."""
    upper = prefix_upper_bound(prefix.encode())
    low = key >= F.lit(prefix)
    return low if upper is None else low & (key < F.lit(upper.decode()))


def expired(expires: Column, now: Column | int) -> Column:
    """Inclusive: a record is gone in the very millisecond it names."""
    return F.coalesce(expires <= now, F.lit(False))


def visible(deleted: Column, expires: Column, now: Column | int) -> Column:
    return ~deleted & ~expired(expires, now)


def in_range(key: Column, start: Column, end: Column) -> Column:
    """Half-open; a null end is unbounded."""
    return (key >= start) & (end.isNull() | (key < end))


def range_display(start: Column, end: Column) -> Column:
    """A range as operators read it: [-inf, m), [m, +inf)."""
    return F.concat(F.lit("["), F.when(start == "", "-inf").otherwise(start), F.lit(", "), F.coalesce(end, F.lit("+inf")), F.lit(")"))


def fnv1a(data: bytes) -> int:
    value = FNV_OFFSET
    for byte in data:
        value = (value ^ byte) * FNV_PRIME % (1 << 64)
    return value


def encode_cursor(prefix: bytes, last_key: bytes) -> bytes:
    """Version, the prefix's FNV-1a (big-endian), the last key returned."""
    return CURSOR + fnv1a(prefix).to_bytes(8, "big") + last_key


def decode_cursor(prefix: bytes, cursor: bytes) -> bytes:
    """The key to go on after. ValueError for another version, another prefix or a cut-off cursor."""
    if len(cursor) < 9 or cursor[:1] != CURSOR:
        raise ValueError("malformed cursor")
    if int.from_bytes(cursor[1:9], "big") != fnv1a(prefix):
        raise ValueError("cursor of another prefix")
    return cursor[9:]


def encode_route(inner: bytes, route_key: bytes) -> bytes:
    """A cursor across partitions: version, length of the inner cursor (big-endian), it, the key that routes."""
    return CURSOR + len(inner).to_bytes(4, "big") + inner + route_key


def decode_route(cursor: bytes) -> tuple[bytes, bytes]:
    if len(cursor) < 5 or cursor[:1] != CURSOR:
        raise ValueError("malformed cursor")
    size = int.from_bytes(cursor[1:5], "big")
    if len(cursor) < 5 + size:
        raise ValueError("malformed cursor")
    return cursor[5 : 5 + size], cursor[5 + size :]


def scan_start(prefix: bytes, range_start: bytes, range_end: bytes | None, after: bytes | None) -> bytes | None:
    """Where a page begins: strictly after the last key, never before the range; None past its end."""
    start = max(prefix, range_start, after + b"\x00" if after is not None else b"")
    return None if range_end is not None and start >= range_end else start


def next_range_start(prefix: bytes, range_end: bytes | None) -> bytes | None:
    """Where the next partition's page begins, unless the prefix ends within this one."""
    upper = prefix_upper_bound(prefix)
    return None if range_end is None or (upper is not None and range_end >= upper) else range_end
