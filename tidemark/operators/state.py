"""From a log of mutations to versioned state, and reads of that state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import expired, in_prefix, visible
from tidemark.operators.folds import fold
from tidemark.operators.ordered import COUNT, before

KEY = ["keyspace_id", "key"]
ENTRY_OVERHEAD = 64
RECORD = ["deleted", "value_bytes", "expires_at_millis"]
MAX_LONG = (1 << 63) - 1


def replay(log: DataFrame, by: list[str] = KEY) -> DataFrame:
    """The newest record of each key: one max_by, combined before its one exchange."""
    newest = F.max_by(F.struct(*RECORD), "lamport").alias("r")
    return log.groupBy(*by).agg(F.max("lamport").alias("version"), newest).select(*by, "version", *[f"r.{c}" for c in RECORD])


def replay_above(base: DataFrame, log: DataFrame, horizon: Column | int) -> DataFrame:
    """State resumed from a base: only mutations above the horizon count, replayed ones change nothing."""
    return replay(
        base.withColumnRenamed("version", "lamport").select(*KEY, "lamport", *RECORD).unionByName(log.where(F.col("lamport") > horizon).select(*KEY, "lamport", *RECORD))
    )


def clock(log: DataFrame) -> Column:
    """The log's own latest time, as the clock reading that queries are given: a one-row side of the plan, not a scan before it."""
    return log.agg(F.max("now_millis")).scalar()


def live(state: DataFrame, now: Column | int) -> DataFrame:
    return state.where(visible(F.col("deleted"), F.col("expires_at_millis"), now))


def reclaimable(state: DataFrame, now: Column | int) -> DataFrame:
    return state.where(F.col("deleted") | expired(F.col("expires_at_millis"), now))


def saturating_expiry(now: Column, ttl: Column) -> Column:
    """now + ttl, at most the largest time; null for no ttl."""
    return F.when(ttl.isNotNull(), F.coalesce(F.try_add(now, ttl), F.lit(MAX_LONG)))


def reclaim_deadline(op: Column, deadline: Column) -> Column:
    """When a logged delete's tombstone may go: at its deadline, at once (0) where the entry has none; null for a put."""
    return F.when(op == "delete", F.coalesce(deadline, F.lit(0).cast("long")))


def footprint(key: Column, value_bytes: Column) -> Column:
    return F.octet_length(key) + value_bytes + ENTRY_OVERHEAD


def multi_get(keys: DataFrame, state: DataFrame, now: Column | int) -> DataFrame:
    """One row a wanted key: found or not, never an error."""
    rows = live(state, now).withColumn("found", F.lit(True))
    return keys.join(rows, KEY, "left").select(
        *KEY, F.coalesce("found", F.lit(False)).alias("found"), "version", "value_bytes", "expires_at_millis",
    )


def overlay(state: DataFrame, pending: DataFrame, now: Column | int) -> DataFrame:
    """Committed records under writes in flight: the higher version wins, a pending delete hides."""
    both = state.select(*KEY, F.col("version").alias("lamport"), *RECORD).unionByName(pending.select(*KEY, "lamport", *RECORD))
    return live(replay(both), now)


def listing(state: DataFrame, prefix: str, now: Column | int) -> DataFrame:
    """Live keys under a prefix. The range form reaches the scan; order is the caller's."""
    return live(state.where(in_prefix(F.col("key"), prefix)), now)


def pages(rows: DataFrame, limit: int, by: list[str]) -> DataFrame:
    """Page numbers by count over rows already visible."""
    placed = before(rows, by, ["key"], {"place_before": (COUNT, None)})
    return placed.withColumn("page", F.floor(F.col("place_before") / limit).cast("long")).drop("place_before")


def pages_by_bytes(rows: DataFrame, max_bytes: int, limit: int, by: list[str], size: Column) -> DataFrame:
    """``rows`` with page numbers by bytes and count, whichever binds first; a page's first entry always goes in.

    Each page's start depends on the last one's, so a group's keys stream in order past (page, bytes, entries).
    """

    def step(page: tuple[int, int, int], own: int) -> tuple[tuple, tuple[int]]:
        number, held, entries = page
        if not entries or held + own > max_bytes or entries >= limit:
            return (number + 1, own, 1), (number + 1,)
        return (number, held + own, entries + 1), (number,)

    sized = rows.withColumn("size_", size.cast("long"))
    return fold(sized, by, ["key"], ["size_"], "page long", lambda: (-1, 0, 0), step).drop("size_")
