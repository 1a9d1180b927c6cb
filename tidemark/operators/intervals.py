"""Keys against ranges of keys: sorted boundaries and a binary search in place of a join of every key with every range."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Ranges of one block, which bounds what is sent at once to about 100 MB; more ranges make more passes over the keys.
BLOCK = 200_000


class Ranges:
    """Half-open ranges [low, high) of keys in groups, cut where any of them begins or ends.

    Between two cuts the same ranges hold, so what they say there is worked out once by a
    sweep: ``answers(group)`` makes an object with ``add(range)``, ``drop(range)`` and ``now()``.
    Strings compare by code point, which is the order of their UTF-8 bytes.
    """

    def __init__(self, rows: list[tuple], answers: Callable[[], Any]) -> None:
        events: dict[Any, dict[str, tuple[list, list]]] = {}
        for place, (group, low, high, *own) in enumerate(rows):
            if high is None or low < high:
                at = events.setdefault(group, {})
                at.setdefault(low, ([], []))[0].append((place, *own))
                if high is not None:
                    at.setdefault(high, ([], []))[1].append((place, *own))
        self.cuts: dict[Any, list[str]] = {}
        self.said: dict[Any, list[Any]] = {}
        for group, at in events.items():
            sweep, self.cuts[group], self.said[group] = answers(), sorted(at), []
            for cut in self.cuts[group]:
                began, ended = at[cut]
                for own in ended:
                    sweep.drop(own)
                for own in began:
                    sweep.add(own)
                self.said[group].append(sweep.now())

    def at(self, group: Any, key: str | None) -> Any:
        """What the sweep says at a key; None before the first cut."""
        cuts = self.cuts.get(group)
        place = bisect_right(cuts, key) - 1 if cuts and key is not None else -1
        return self.said[group][place] if place >= 0 else None


class Held:
    """The ranges that hold, as a tuple of what they carry."""

    def __init__(self) -> None:
        self.held: dict[int, Any] = {}

    def add(self, own: tuple) -> None:
        self.held[own[0]] = own[1]

    def drop(self, own: tuple) -> None:
        del self.held[own[0]]

    def now(self) -> tuple:
        return tuple(self.held.values())


class Best:
    """(how many ranges hold, least ``order`` of theirs, what that one carries); a range is (place, order, carried)."""

    def __init__(self) -> None:
        self.heap: list[tuple] = []
        self.gone: set[int] = set()
        self.count = 0

    def add(self, own: tuple) -> None:
        heapq.heappush(self.heap, (own[1], own[0], own[2]))
        self.count += 1

    def drop(self, own: tuple) -> None:
        self.gone.add(own[0])
        self.count -= 1

    def now(self) -> tuple:
        while self.heap and self.heap[0][1] in self.gone:
            heapq.heappop(self.heap)
        return (self.count, self.heap[0][0], self.heap[0][2]) if self.heap else (0, None, None)


def _blocks(ranges: DataFrame, block: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in ranges.toLocalIterator():
        held.append(tuple(row))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def locate(
    rows: DataFrame, ranges: DataFrame, answers: Callable[[], Any], adds: str,
    combine: Callable[[tuple | None, Any], tuple], none: tuple, group: str = "keyspace_id", key: str = "key",
    block: int = BLOCK,
) -> DataFrame:
    """``rows`` with the columns ``adds``: what the ranges (group, low, high, ...) that hold each row's key say.

    ``combine(values so far, answer)`` adds a block of ranges to the values of ``adds``,
    which begin as ``none``. The ranges are those of a map or of a store's files; they are
    streamed in blocks and each block is one pass over the keys, in the same way at every
    number. Keys are not exchanged, so a hot group of them costs nothing more.
    """
    made = StructType.fromDDL(adds)
    kinds = [to_arrow_type(f.dataType) for f in made]
    schema = StructType([*rows.schema.fields, *made.fields])
    width, started = len(rows.columns), False
    for held in _blocks(ranges, block):
        shared = rows.sparkSession.sparkContext.broadcast(Ranges(held, answers))
        rows = rows.mapInArrow(_pass(shared, group, key, width, kinds, made.names, combine, none, started), schema)
        started = True
    if not started:
        rows = rows.mapInArrow(_pass(None, group, key, width, kinds, made.names, combine, none, started), schema)
    return rows


def _pass(shared, group: str, key: str, width: int, kinds: list, names: list[str], combine, none: tuple, started: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*(batch.column(c).to_pylist() for c in names)) if started else [none] * batch.num_rows
            if shared is None:
                out = list(found)
            else:
                at = shared.value.at
                out = [combine(before, at(g, k)) for before, g, k in zip(
                    found, batch.column(group).to_pylist(), batch.column(key).to_pylist(),
                )]
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[*batch.schema.names[:width], *names],
            )

    return run
