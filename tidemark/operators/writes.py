"""Conditional writes: an order-dependent fold of each key's requests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.folds import fold

TOMBSTONE_MILLIS = 24 * 3600 * 1000
KEY = ["keyspace_id", "key"]
OUTCOME = "lamport long, op string, applied boolean, found_version long, new_version long"


class Cell:
    """One key's record and how requests change it. layer 'server': a delete of an invisible key applies and writes nothing."""

    __slots__ = ("deleted", "expires", "layer", "version")

    def __init__(self, version: int = 0, deleted: bool = False, expires: int | None = None, layer: str = "server") -> None:
        self.version, self.deleted, self.expires, self.layer = version, deleted, expires, layer

    def visible_version(self, now: int) -> int:
        """0 where no live record is."""
        gone = self.version == 0 or self.deleted or (self.expires is not None and now >= self.expires)
        return 0 if gone else self.version

    def apply(self, lamport: int, op: str, cond: str, expected: int | None, expires: int | None, now: int) -> tuple[bool, int, int]:
        """(applied, version found, version after; 0 for none written)."""
        found = self.visible_version(now)
        if (cond == "if_not_present" and found) or (cond == "if_version" and found != expected):
            return False, found, 0
        if op == "delete":
            if self.layer == "server" and not found:
                return True, 0, 0
            if self.layer == "storage" and self.deleted and self.version and (self.expires is None or now < self.expires):
                return True, self.version, 0
            self.version, self.deleted, self.expires = lamport, True, now + TOMBSTONE_MILLIS
        else:
            self.version, self.deleted, self.expires = lamport, False, expires
        return True, found, lamport


def cas(requests: DataFrame, layer: str = "server") -> DataFrame:
    """(keyspace_id, key, lamport, op, applied, found_version, new_version) of every write request.

    Requests: keyspace_id, key, lamport, op (put or delete), cond, expected,
    expires_at_millis, now_millis. Each key's requests are folded in order of lamport by
    the rules of ``layer``, one record in memory. A condition sees expired and deleted
    records as absent; what fails returns the version it found.
    """

    def step(cell: Cell, *request) -> tuple[Cell, tuple]:
        return cell, cell.apply(*request)

    reads = ["lamport", "op", "cond", "expected", "expires_at_millis", "now_millis"]
    folded = fold(
        requests.select(*KEY, *reads), KEY, ["lamport"], reads,
        "applied boolean, found_version long, new_version long", lambda: Cell(layer=layer), step,
    )
    return folded.select(*KEY, "lamport", "op", "applied", "found_version", "new_version")
