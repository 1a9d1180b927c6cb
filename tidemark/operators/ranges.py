"""Range partitions: routing, coverage, split and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import BLOCK, Held, locate


def route(keys: DataFrame, partitions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row of ``keys`` (keyspace_id, key, ...) with its partition_id; unrouted rows are left out.

    A key of several partitions (in a map with overlaps) gives a row each.
    """
    ranges = partitions.select("keyspace_id", "start_key", "end_key", "partition_id")
    kind = partitions.schema["partition_id"].dataType.simpleString()
    found = locate(keys, ranges, Held, f"ids_ array<{kind}>", lambda before, now: ([*before[0], *(now or ())],), ([],), block=block)
    return found.select(*keys.columns, F.explode("ids_").alias("partition_id"))


def coverage_errors(partitions: DataFrame) -> DataFrame:
    """Every gap and overlap of each keyspace's ranges, with the key where it begins."""
    order = Window.partitionBy("keyspace_id").orderBy("start_key", "partition_id")
    rows = partitions.withColumn("before", F.lag("end_key").over(order)).withColumn("first", F.row_number().over(order) == 1).withColumn("last", F.lead("start_key").over(order).isNull())
    found = lambda error, at: F.struct(F.lit(error).alias("error"), at.alias("at"))
    kinds = F.array(
        F.when(F.col("first") & (F.col("start_key") != ""), found("gap_at_start", F.lit(""))),
        F.when(~F.col("first") & (F.col("before").isNull() | (F.col("before") > F.col("start_key"))), found("overlap", F.col("start_key"))),
        F.when(~F.col("first") & (F.col("before") < F.col("start_key")), found("gap", F.col("before"))),
        F.when(F.col("last") & F.col("end_key").isNotNull(), found("gap_at_end", F.col("end_key"))),
    )
    return rows.select("keyspace_id", "partition_id", F.inline(F.array_compact(kinds)))


def split(partitions: DataFrame, at: Column) -> DataFrame:
    """The two children of each range whose split key lies strictly inside; others are left out."""
    inside = partitions.withColumn("at", at).where((F.col("at") > F.col("start_key")) & (F.col("end_key").isNull() | (F.col("at") < F.col("end_key"))))
    child = lambda side, start, end: F.struct(
        F.lit(side).alias("side"), F.col(start).alias("child_start"), F.col(end).alias("child_end"),
    )
    children = F.array(child("lower", "start_key", "at"), child("upper", "at", "end_key"))
    return inside.select("keyspace_id", "partition_id", F.inline(children))


def adjacent(partitions: DataFrame) -> DataFrame:
    """(keyspace_id, lower, upper) partitions whose ranges meet."""
    lower = partitions.select("keyspace_id", F.col("partition_id").alias("lower"), F.col("end_key").alias("meet"))
    upper = partitions.select("keyspace_id", F.col("partition_id").alias("upper"), F.col("start_key").alias("meet"))
    return lower.join(upper, ["keyspace_id", "meet"])


def caught_up(candidates: DataFrame, status: DataFrame, eligible: DataFrame, owners: DataFrame) -> DataFrame:
    """Those of ``candidates`` (partition_id, node_id) that may take ownership without losing a write.

    A candidate must be eligible and have reported a durable position at or above what the
    owner has committed (else made durable, else 0). No report is no evidence.
    """
    required = owners.join(status, ["partition_id", "node_id"], "left").select(
        "partition_id", F.coalesce("committed", "durable", F.lit(0)).alias("required"),
    )
    known = candidates.join(
        status.select("partition_id", "node_id", "durable"), ["partition_id", "node_id"],
    ).join(required, "partition_id", "left")
    return known.where(F.col("durable") >= F.coalesce("required", F.lit(0))).join(eligible.select("node_id"), "node_id", "left_semi")
