"""Words and shingles of whole batches of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 19


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


_cache: dict[str, np.ndarray] = {"up": _powers(BASE, 1 << 16), "down": _powers(INVERSE, 1 << 16)}


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_cache["up"]):
        more = max(n, 2 * len(_cache["up"]))
        if more > 4 * CHUNK:
            return _powers(BASE, n), _powers(INVERSE, n)  # too long to keep
        _cache.update(up=_powers(BASE, more), down=_powers(INVERSE, more))
    return _cache["up"][:n], _cache["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes together stay within ``most`` where one document does."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of true bytes; runs end where a document does."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes."""
    up, down = _upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of first word) of every run of ``width`` words inside one document."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words[:n].copy()
    for k in range(1, width):
        out = out * BASE + words[k : k + n]
    whole = np.flatnonzero(docs[:n] == docs[width - 1 :])
    return mixed(out[whole]), whole
