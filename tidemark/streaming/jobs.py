"""Replay, conditional writes, rate limits and health over streams, with the batch operators' rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.admission import take_token
from tidemark.operators.control import DEAD_MILLIS, SUSPECT_MILLIS
from tidemark.operators.state import KEY, RECORD
from tidemark.operators.writes import OUTCOME, Cell

REPLAYED = "keyspace_id long, key string, version long, deleted boolean, value_bytes long, expires_at_millis long"


def replay(mutations: DataFrame) -> DataFrame:
    """The state after each batch, in update mode: the same max_by as the batch replay, so late or repeated mutations change nothing."""
    newest = F.max_by(F.struct(*RECORD), "lamport").alias("r")
    return mutations.groupBy(*KEY).agg(F.max("lamport").alias("version"), newest).select(*KEY, "version", *[f"r.{c}" for c in RECORD])


def dedup(mutations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (keyspace_id, lamport) once, within a watermark on ``at``."""
    return mutations.withWatermark("at", delay).dropDuplicatesWithinWatermark(["keyspace_id", "lamport"])


def _sorted(batches: Iterator[pd.DataFrame], by: str, columns: list[str]) -> Iterator[tuple]:
    """The rows of a batch in order, as Python's integers; those that may be null come as text, since pandas would round them."""
    rows = pd.concat(list(batches)).sort_values(by)
    for own in rows[columns].itertuples(index=False):
        yield tuple(None if v is None or v != v else int(v) for v in own)


def cas(requests: DataFrame) -> DataFrame:
    """Outcomes of conditional writes, one record of state a key.

    A batch's requests of a key are put in order of lamport; one at or below the key's last
    is a repeat and ignored, so batches must arrive in order for the result to be the batch fold's.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, version, deleted, expires = state.get if state.exists else (0, 0, False, None)
        cell, out = Cell(version, deleted, expires), []
        rows = pd.concat(list(batches)).sort_values("lamport")
        values = _sorted([rows], "lamport", ["lamport", "expected", "expires_at_millis", "now_millis"])
        for (lamport, expected, until, now), op, cond in zip(values, rows["op"], rows["cond"]):
            if lamport > last:
                last = lamport
                out.append((*key, last, op, *cell.apply(last, op, cond, expected, until, now)))
        state.update((last, cell.version, cell.deleted, cell.expires))
        yield pd.DataFrame(out, columns=[*KEY, "lamport", "op", "applied", "found_version", "new_version"])

    exact = requests.select(
        *KEY, "lamport", "op", "cond", F.col("expected").cast("string").alias("expected"),
        F.col("expires_at_millis").cast("string").alias("expires_at_millis"), "now_millis",
    )
    return exact.groupBy(*KEY).applyInPandasWithState(
        fold, "keyspace_id long, key string, " + OUTCOME,
        "last long, version long, deleted boolean, expires long", "append", GroupStateTimeout.NoTimeout,
    )


def rate_limit(requests: DataFrame) -> DataFrame:
    """(bucket, place, admitted) of (bucket, place, at_micros, rate) requests, one token bucket of state each."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = state.get if state.exists else (0, None, None)
        out = []
        for place, now, rate in _sorted(batches, "place", ["place", "at_micros", "rate"]):
            admitted = True
            if rate is not None:
                bucket, (admitted,) = take_token(bucket, now, rate)
            out.append((*key, place, admitted))
        state.update(bucket)
        yield pd.DataFrame(out, columns=["bucket", "place", "admitted"])

    exact = requests.select("bucket", "place", "at_micros", F.col("rate").cast("string").alias("rate"))
    return exact.groupBy("bucket").applyInPandasWithState(
        fold, "bucket string, place long, admitted boolean", "tokens long, last long, rate long", "append",
        GroupStateTimeout.NoTimeout,
    )


def node_health(heartbeats: DataFrame) -> DataFrame:
    """(node_id, heard_at, health) in update mode; the clock is data too, the latest ``now_millis`` that a row of the node brings."""
    heard = heartbeats.groupBy("node_id").agg(F.max("heard_millis").alias("heard_at"), F.max("now_millis").alias("now"))
    silent = F.col("now") - F.col("heard_at")
    return heard.select(
        "node_id", "heard_at",
        F.when(silent >= DEAD_MILLIS, "dead").when(silent >= SUSPECT_MILLIS, "suspect").otherwise("healthy").alias("health"),
    )
