"""Control-plane rules over recorded state: health, eligibility, placement, repair, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUSPECT_MILLIS, DEAD_MILLIS = 1_000, 3_000
ACTIVE = (0, 2)  # the cluster version in force
REPLICATION, SKEW = 3, 2


def health(silent: Column) -> Column:
    return F.when(silent >= DEAD_MILLIS, "dead").when(silent >= SUSPECT_MILLIS, "suspect").otherwise("healthy")


def version(major: str, minor: str) -> Column:
    """Comparable as a whole, major first."""
    return F.struct(F.col(major).cast("long").alias("major"), F.col(minor).cast("long").alias("minor"))


def speaks(target: tuple[int, int]) -> Column:
    wanted = F.struct(F.lit(target[0]).cast("long").alias("major"), F.lit(target[1]).cast("long").alias("minor"))
    return (version("min_major", "min_minor") <= wanted) & (wanted <= version("max_major", "max_minor"))


def eligible(nodes: DataFrame, active: tuple[int, int] = ACTIVE) -> DataFrame:
    """Nodes that may be given ownership: healthy workers that speak the active version and, from 0.1 on, are ready and not draining."""
    rule = (F.col("role") == "worker") & (health(F.col("silent_millis")) == "healthy") & speaks(active)
    return nodes.where(rule & (F.col("ready") & ~F.col("draining")) if active >= (0, 1) else rule)


def holders(partitions: DataFrame, replicas: DataFrame) -> DataFrame:
    """(partition_id, node_id, owned): owners and replicas."""
    own = partitions.where("owner IS NOT NULL").select("partition_id", F.col("owner").alias("node_id"), F.lit(True).alias("owned"))
    return own.union(replicas.select("partition_id", "node_id", F.lit(False)))


def held(partitions: DataFrame, replicas: DataFrame) -> DataFrame:
    return holders(partitions, replicas).groupBy("node_id").agg(F.count("*").alias("held"), F.count_if("owned").alias("owned"))


def placement(nodes: DataFrame, partitions: DataFrame, replicas: DataFrame) -> DataFrame:
    """Eligible nodes by how little they hold, then by id. A control plane's nodes are few, so one ranking does."""
    counts = held(partitions, replicas)
    rows = eligible(nodes).select("node_id").join(counts, "node_id", "left").select(
        "node_id", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("owned", F.lit(0)).alias("owned"),
    )
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("held", "node_id")).cast("long"))


def child_owner(partitions: DataFrame, prepared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(partition_id, child_owner): of the ``prepared`` (partition_id, node_id) and eligible nodes the one that owns least, ties by id; else the parent's owner.

    What a node holds does not count: in a small cluster all hold the same.
    """
    owned = partitions.where("owner IS NOT NULL").groupBy(F.col("owner").alias("node_id")).agg(F.count("*").alias("owned"))
    able = prepared.select("partition_id", "node_id").join(eligible(nodes).select("node_id"), "node_id", "left_semi").join(owned, "node_id", "left")
    best = able.groupBy("partition_id").agg(F.min(F.struct(F.coalesce("owned", F.lit(0)).alias("owned"), "node_id"))["node_id"].alias("best"))
    return partitions.select("partition_id", "owner").join(best, "partition_id", "left").select(
        "partition_id", F.coalesce("best", "owner").alias("child_owner"),
    )


def read_replica_want(target: Column, floor: Column, placeable: Column) -> Column:
    """How many replicas reads may have: up to one below half the nodes, but never fewer than durability asks for."""
    return F.greatest(F.least(target, F.greatest(F.floor(placeable / 2) - 1, F.lit(0))), floor)


def poisoned_sum(x: Column) -> Column:
    """Null as soon as one part is unknown; no parts: 0."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.coalesce(F.sum(x), F.lit(0)))


def replica_lag(committed: Column, position: Column) -> Column:
    """Of a group: the largest known distance, 0 if none is known, null if the owner's is unknown."""
    return F.when(F.max(committed).isNotNull(), F.coalesce(F.max(F.greatest(committed - position, F.lit(0))), F.lit(0)))


def promotions(fenced: DataFrame, replicas: DataFrame, nodes: DataFrame, status: DataFrame) -> DataFrame:
    """(partition_id, candidate) of fenced partitions: every living replica must have reported past the fence, and the
    smallest eligible node with the highest durable position among them is chosen; else null."""
    known = nodes.select("node_id", (health(F.col("silent_millis")) == "dead").alias("dead"))
    rows = fenced.select("partition_id", "fence_map_version").join(
        replicas.select("partition_id", "node_id"), "partition_id", "left",
    ).join(known, "node_id", "left").join(
        status.select("partition_id", "node_id", "map_version", "durable"), ["partition_id", "node_id"],
        "left",
    )
    rows = rows.join(eligible(nodes).select("node_id", F.lit(True).alias("may")), "node_id", "left")
    settled = F.bool_and(
        F.col("node_id").isNull() | F.coalesce(F.col("dead"), F.lit(False)) | (F.col("dead").isNotNull() & F.coalesce(
            F.col("map_version") >= F.col("fence_map_version"), F.lit(False),
        ))
    )
    required = rows.groupBy("partition_id").agg(settled.alias("settled"), F.max(F.when(~F.col("dead"), F.col("durable"))).alias("required"))
    choice = rows.join(required, "partition_id").groupBy("partition_id").agg(
        F.min(F.when(F.col("settled") & F.col("may") & (F.col("durable") == F.col("required")), F.col("node_id"))).alias("candidate")
    )
    return choice


def repair(partitions: DataFrame, replicas: DataFrame, nodes: DataFrame, want: int) -> DataFrame:
    """(partition_id, before, after) of serving partitions whose replica list changes: the dead go, the best placed come, up to ``want``.

    Both lists are as short as a replica set; the ranking of candidates is one small array.
    """
    living = nodes.where(health(F.col("silent_millis")) != "dead").select("node_id", F.lit(True).alias("alive"))
    rows = replicas.join(living, "node_id", "left").groupBy("partition_id").agg(F.array_sort(F.collect_list(F.struct("position", "node_id", "alive"))).alias("r"))
    ranked = placement(nodes, partitions, replicas).where(F.col("rank") <= want + REPLICATION + 1).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("ranked")
    )
    lists = partitions.where("phase = 'serving' AND owner IS NOT NULL").select("partition_id", "owner").join(rows, "partition_id", "left").crossJoin(F.broadcast(ranked))  # one row
    empty = F.array().cast("array<bigint>")
    before = F.coalesce(F.transform("r", lambda x: x["node_id"]), empty)
    kept = F.coalesce(F.transform(F.filter("r", lambda x: F.coalesce(x["alive"], F.lit(False))), lambda x: x["node_id"]), empty)
    more = F.filter("ranked", lambda n: (n != F.col("owner")) & ~F.array_contains(kept, n))
    after = F.concat(kept, F.slice(more, F.lit(1), F.greatest(F.lit(want) - F.size(kept), F.lit(0))))
    return lists.select("partition_id", before.alias("before"), after.alias("after")).where("before <> after")
