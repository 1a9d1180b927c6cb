"""A value cache with a byte budget, replayed over the reads it served."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame

from tidemark.operators.folds import fold


class Cache:
    """Least recently used first out; a value larger than the budget is never held."""

    def __init__(self, budget: int) -> None:
        self.budget, self.held, self.entries = budget, 0, OrderedDict()

    def read(self, key: str, version: int, size: int) -> tuple[bool, int]:
        """Whether the read hits, and how many entries it pushes out. Another version of the key is a miss and replaces it."""
        known = self.entries.get(key)
        if known and known[0] == version:
            self.entries.move_to_end(key)
            return True, 0
        if known:
            self.held -= self.entries.pop(key)[1]
        if size > self.budget:
            return False, 0
        self.entries[key] = (version, size)
        self.held += size
        gone = 0
        while self.held > self.budget:
            _, (_, least) = self.entries.popitem(last=False)
            self.held -= least
            gone += 1
        return False, gone


def lru(reads: DataFrame, budget: int) -> DataFrame:
    """``reads`` (node_id, place, key, version, size) with ``hit`` and ``evicted``, a cache of ``budget`` bytes a node."""

    def step(cache: Cache, *read) -> tuple[Cache, tuple]:
        return cache, cache.read(*read)

    return fold(reads, ["node_id"], ["place"], ["key", "version", "size"], "hit boolean, evicted int", lambda: Cache(budget), step)
