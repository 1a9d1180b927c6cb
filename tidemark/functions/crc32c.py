"""CRC32C (Castagnoli), whole columns in step: a word of all blocks of all rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL = 0x82F63B78  # reflected
BLOCK, STEP, SHORT = 64, 1 << 14, 1 << 10  # bytes a block, blocks at once (they stay in the cache), bytes by a plain loop


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def _shift(x: np.ndarray, size: int) -> np.ndarray:
    """Registers after so many zero bytes."""
    for _ in range(size):
        x = TABLE[x & 255] ^ (x >> 8)
    return x


def _apply(halves: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """A shift, which is linear, by its tables of the lower and the upper 16 bits."""
    return halves[0][x & 0xFFFF] ^ halves[1][x >> 16]


def _preset() -> bytes:
    """The four bytes that take a register from 0 to all ones, so that rows need no start of their own."""
    top, x = {int(v) >> 24: i for i, v in enumerate(TABLE)}, 0xFFFFFFFF
    for _ in range(4):
        i = top[x >> 24]
        x = ((x ^ int(TABLE[i])) << 8 | i) & 0xFFFFFFFF
    return x.to_bytes(4, "little")


TABLE = _table()
PLAIN = TABLE.tolist()
LOW = np.arange(1 << 16, dtype=np.uint32)
WORD = _shift(LOW, 4), _shift(LOW << 16, 4)
SHIFTS = [(_shift(LOW, BLOCK), _shift(LOW << 16, BLOCK))]  # by 1, 2, 4, ... blocks, as rows need them
PRESET, ZEROS = _preset(), bytes(BLOCK)


def checksum(data: bytes) -> int:
    """The checksum of one row."""
    if len(data) > SHORT:
        return int(crc32c([data])[0])
    x = 0xFFFFFFFF
    for b in data:
        x = PLAIN[(x ^ b) & 255] ^ (x >> 8)
    return x ^ 0xFFFFFFFF


def crc32c(rows: list[bytes | None]) -> np.ndarray:
    """The checksum of each row; a null counts as empty.

    Each row fills whole blocks from the right; leading zeros leave a register of 0 as it is. A block's
    register is shifted past the blocks after it, by powers of two, and a row's are summed.
    """
    parts = []
    for r in rows:
        r = r or b""
        parts += (ZEROS[: -(len(r) + 4) % BLOCK], PRESET, r)
    count = (np.fromiter(map(len, parts[2::3]), np.int64, len(rows)) + 4 + BLOCK - 1) // BLOCK
    words = np.frombuffer(b"".join(parts), "<u4").reshape(-1, BLOCK // 4)
    crc = np.zeros(len(words), np.uint32)
    for at in range(0, len(words), STEP):
        x = crc[at : at + STEP]
        for word in words[at : at + STEP].T:
            x = _apply(WORD, x ^ word)
        crc[at : at + STEP] = x
    ends = np.cumsum(count)
    after = np.repeat(ends, count) - 1 - np.arange(len(words))
    for bit in range(int(count.max(initial=0)).bit_length()):
        if bit == len(SHIFTS):
            SHIFTS.append(tuple(_apply(SHIFTS[-1], half) for half in SHIFTS[-1]))
        far = np.flatnonzero(after >> bit & 1)
        crc[far] = _apply(SHIFTS[bit], crc[far])
    return np.bitwise_xor.reduceat(crc, ends - count) ^ np.uint32(0xFFFFFFFF) if len(rows) else crc


def crc32c_column(value: Column) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(crc32c([None if v is None else bytes(v) for v in batch]).astype(np.int64))

    return of(value)
