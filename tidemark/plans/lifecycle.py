"""Adoption, pruning, value objects, ownership of children, and the command log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.crc32c import crc32c_column
from tidemark.functions.keys import range_display as shown_range
from tidemark.operators import cache, cluster
from tidemark.operators import control as C
from tidemark.operators import lsm as L
from tidemark.operators import state as S
from tidemark.plans.controlling import ELIGIBLE
from tidemark.plans.registry import query
from tidemark.plans.storage import COVERED, EXPIRED, WON, _mid
from tidemark.session import shared_folder


@query(
    "mutation_log segment_records segments manifests",
    "WITH " + WON.format(src="segment_records WHERE sequence >= 5") + ", " + WON.replace("won AS", "whole AS").format(src="segment_records") + f""", kept AS (SELECT * FROM won WHERE NOT {EXPIRED} OR {COVERED})
    SELECT k.keyspace_id, k.key, k.lamport, k.deleted FROM kept k JOIN whole w ON w.keyspace_id = k.keyspace_id AND w.key = k.key AND w.lamport = k.lamport
    JOIN manifests m ON m.keyspace_id = k.keyspace_id WHERE k.key >= m.start_key AND (m.end_key IS NULL OR k.key < m.end_key)""",
)
def compact_pruned(t):
    """A bounded merge, of which only what the exact index holds in the partition's own range is written."""
    merged = L.merge_bounded(t("segment_records").where("sequence >= 5"), t("segments").where("sequence < 5"), _mid(t))
    return L.prune_merged(merged, L.winners(t("segment_records")), t("manifests")).select(*S.KEY, "lamport", "deleted")


@query("mutations", """WITH h AS (SELECT keyspace_id, max(lamport) - 300 AS horizon FROM mutations GROUP BY 1), n AS (SELECT keyspace_id, key, max(lamport) AS version FROM mutations GROUP BY 1, 2)
  SELECT keyspace_id, count(*) AS records, min(key) AS min_key, max(key) AS max_key, min(version) AS min_lamport, max(version) AS max_lamport, TRUE AS ordered FROM n JOIN h USING (keyspace_id) WHERE version <= horizon GROUP BY 1""")
def flush_written(t):
    """A flush, really written: what is committed goes to sorted runs in the shared folder, and is read back with each file's order checked."""
    log = t("mutations")
    horizon = log.groupBy("keyspace_id").agg((F.max("lamport") - 300).alias("horizon"))
    done = S.replay(log).join(F.broadcast(horizon), "keyspace_id").where("version <= horizon").drop("horizon")  # a row a configured keyspace
    folder = f"{shared_folder(log.sparkSession)}/flush/{uuid.uuid4().hex}"
    L.flush(done, folder)
    back = log.sparkSession.read.schema(done.schema).parquet(folder).select(
        "*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"),
    )
    files = back.groupBy("file").agg(
        F.min(F.struct(*S.KEY)).alias("low"), F.max(F.struct(*S.KEY)).alias("high"),
        F.min_by(F.struct(*S.KEY), "place").alias("first"), F.max_by(F.struct(*S.KEY), "place").alias("last"),
    )
    ordered = files.agg(
        F.coalesce(F.bool_and((F.col("low") == F.col("first")) & (F.col("high") == F.col("last"))), F.lit(True)).alias("ordered")
    )
    runs = back.groupBy("keyspace_id").agg(
        F.count("*").alias("records"), F.min("key").alias("min_key"), F.max("key").alias("max_key"),
        F.min("version").alias("min_lamport"), F.max("version").alias("max_lamport"),
    )
    return runs.crossJoin(F.broadcast(ordered))  # one row


@query("manifests mutations", """WITH o AS (SELECT keyspace_id, epoch + keyspace_id % 3 - 1 AS epoch, committed - 200 AS committed FROM manifests WHERE keyspace_id <> 4), a AS (SELECT m.keyspace_id, coalesce(o.epoch >= m.epoch, FALSE) AS adopted,
    CASE WHEN o.epoch >= m.epoch THEN o.epoch ELSE m.epoch END AS epoch, CASE WHEN o.epoch >= m.epoch THEN o.committed ELSE m.committed END AS committed FROM manifests m LEFT JOIN o USING (keyspace_id))
  SELECT a.keyspace_id, any_value(adopted) AS adopted, any_value(epoch) AS epoch, any_value(committed) AS committed, count(*) FILTER (NOT (adopted AND lamport <= committed)) AS kept, count(*) FILTER (adopted AND lamport <= committed) AS reclaimed FROM a JOIN mutations USING (keyspace_id) GROUP BY 1""")
def adopt_manifests(t):
    """Manifests offered to replicas: one of an older epoch changes nothing, another empties the memtable up to its horizon."""
    held = t("manifests").select("keyspace_id", "epoch", "committed")
    offered = held.where("keyspace_id <> 4").select(
        "keyspace_id", (F.col("epoch") + F.col("keyspace_id") % 3 - 1).alias("epoch"),
        (F.col("committed") - 200).alias("committed"),
    )
    return L.adopt(offered, held, t("mutations").select("keyspace_id", "lamport"))


@query("", (
    "SELECT doc_id, CASE doc_id % 9 WHEN 5 THEN 'missing' WHEN 3 THEN 'length' WHEN 4 THEN 'checksum' "
    "ELSE 'ok' END AS status FROM documents WHERE length(text) > 0"
))
def external_values(t):
    """Records whose values lie in objects of their own, joined by name: some objects are gone, cut short or changed in a byte."""
    body = F.col("text").cast("binary")
    docs = t("documents").where("length(text) > 0").select(
        "doc_id",
        F.concat(F.lit("values/"), F.lpad(F.lower(F.hex("doc_id")), 16, "0"), F.lit("-0000000000000001.oval")).alias("name"),
        body.alias("body"),
    )
    records = docs.select("doc_id", "name", F.length("body").alias("length"), crc32c_column(F.col("body")).alias("crc32c"))
    size = F.length("body")
    damaged = F.when(F.col("doc_id") % 9 == 3, F.substring("body", 1, 2**30).substr(F.lit(1), size - 1)).when(
        F.col("doc_id") % 9 == 4, F.concat(F.col("body").substr(F.lit(1), size - 1), F.unhex(F.lit("00"))),
    ).otherwise(F.col("body"))
    return L.external_values(records, docs.where("doc_id % 9 <> 5").select("name", damaged.alias("body"))).select("doc_id", "status")


@query("mutation_log", (
    "SELECT keyspace_id, count(*) AS deletes, count(*) FILTER (lamport % 3 = 0) AS at_once, max(CASE "
    "WHEN lamport % 3 = 0 THEN 0 ELSE now_millis + 86400000 END) AS latest FROM mutation_log WHERE op = 'delete' "
    "GROUP BY 1"
))
def reclaim_deadlines(t):
    """Logged deletes, a third of them without a deadline: those may be reclaimed at once."""
    log = t("mutation_log").where("op = 'delete'").withColumn(
        "deadline", F.when(F.col("lamport") % 3 != 0, F.col("now_millis") + 86_400_000),
    )
    log = log.withColumn("until", S.reclaim_deadline(F.col("op"), F.col("deadline")))
    return log.groupBy("keyspace_id").agg(
        F.count("*").alias("deletes"), F.count_if(F.col("until") == 0).alias("at_once"),
        F.max("until").alias("latest"),
    )


@query("partition_map", (
    "SELECT partition_id, '[' || CASE WHEN start_key = '' THEN '-inf' "
    "ELSE start_key END || ', ' || coalesce(end_key, '+inf') || ')' AS range FROM partition_map"
))
def range_display(t):
    return t("partition_map").select("partition_id", shown_range(F.col("start_key"), F.col("end_key")).alias("range"))


@query("partition_map replicas nodes", f"""WITH {ELIGIBLE}, ow AS (SELECT owner AS node_id, count(*) AS owned FROM partition_map WHERE owner IS NOT NULL GROUP BY 1),
  pr AS (SELECT partition_id, node_id FROM replicas UNION SELECT partition_id, owner FROM partition_map WHERE owner IS NOT NULL AND partition_id % 3 <> 0),
  b AS (SELECT partition_id, arg_min(pr.node_id, coalesce(owned, 0) * 1000000 + pr.node_id) AS best FROM pr JOIN el USING (node_id) LEFT JOIN ow USING (node_id) GROUP BY 1)
  SELECT p.partition_id, coalesce(best, owner) AS child_owner FROM partition_map p LEFT JOIN b USING (partition_id)""")
def child_owners(t):
    """Who would own a split's children, where a third of the owners have not prepared."""
    prepared = C.holders(t("partition_map"), t("replicas")).where("NOT owned OR partition_id % 3 <> 0").select("partition_id", "node_id").distinct()
    return C.child_owner(t("partition_map"), prepared, t("nodes"))


@query("nodes", (
    f"WITH {ELIGIBLE}, n AS (SELECT count(*) AS placeable FROM el) SELECT p_partkey AS target, "
    f"greatest(least(p_partkey, greatest(placeable // 2 - 1, 0)), 2) AS want FROM part CROSS JOIN n"
))
def replica_want(t):
    """Replicas to place for a read target of every size, over the nodes that may hold one."""
    placeable = C.eligible(t("nodes")).agg(F.count("*")).scalar()
    return t("part").select(
        F.col("p_partkey").alias("target"),
        C.read_replica_want(F.col("p_partkey"), F.lit(2), placeable).cast("long").alias("want"),
    )


@query("keyspaces partition_map replicas", (
    "SELECT p.partition_id, p.keyspace_id, count(r.node_id) AS replicas FROM partition_map p LEFT "
    "JOIN replicas r USING (partition_id) WHERE p.keyspace_id NOT IN (SELECT keyspace_id FROM keyspaces "
    "WHERE name LIKE 'a%') GROUP BY 1, 2"
))
def keyspace_deleted(t):
    """What is left when keyspaces are deleted (here those with an a in front): their partitions and these ones' replicas go with them."""
    doomed = t("keyspaces").where("name LIKE 'a%'").select("keyspace_id")
    left = t("partition_map").join(doomed, "keyspace_id", "left_anti").select("partition_id", "keyspace_id")
    return left.join(
        t("replicas").select("partition_id", "node_id"), "partition_id", "left",
    ).groupBy("partition_id", "keyspace_id").agg(F.count("node_id").alias("replicas"))


@query("", """WITH u AS (SELECT o_custkey AS node_id, o_orderkey AS place, o_orderkey * 7919 % 1009 AS version FROM orders), a AS (SELECT *, version > coalesce(max(version) OVER (PARTITION BY node_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS newer FROM u)
  SELECT node_id, max(version) AS version, count(*) FILTER (newer) AS applied, count(*) FILTER (NOT newer) AS refused FROM a GROUP BY 1""")
def newest_maps(t):
    """Maps that reach nodes out of order: an older one never replaces a newer one."""
    from pyspark.sql import Window

    updates = t("orders").select(
        F.col("o_custkey").alias("node_id"), F.col("o_orderkey").alias("place"),
        (F.col("o_orderkey") * 7919 % 1009).alias("version"),
    )
    before = F.max("version").over(Window.partitionBy("node_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = updates.withColumn("newer", F.col("version") > F.coalesce(before, F.lit(-1)))
    return rows.groupBy("node_id").agg(
        F.max("version").alias("version"), F.count_if("newer").alias("applied"),
        F.count_if(~F.col("newer")).alias("refused"),
    )


@query("mutation_log")
def cache_evictions(t):
    """Reads of the log through a cache of two megabytes a node: hits, misses and what is pushed out."""
    reads = t("mutation_log").where("op = 'get'").select(
        (F.col("lamport") % 4).alias("node_id"), F.col("lamport").alias("place"), "key",
        F.lit(1).cast("long").alias("version"), F.col("value_bytes").alias("size"),
    )
    return cache.lru(reads, 2 << 20).groupBy("node_id").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.sum("evicted").alias("evicted"),
    )


def _commands(t):
    """Ten clusters' logs: a start that is the same for all, then commands drawn from orders."""
    import json

    opening = [(
        "register_node",
        {"node": n, "role": "worker", "speaks": [[0, 0], [0, 2]], "ready": True, "draining": False},
    ) for n in range(1, 7)]
    opening += [
        ("set_cluster_version", {"version": [0, 1], "expect": [0, 0]}),
        ("create_keyspace", {"keyspace": 1, "name": "one", "partition": 1, "owner": 1, "replicas": [2, 3]}),
        ("create_keyspace", {"keyspace": 2, "name": "two", "partition": 2, "owner": 2, "replicas": [1, 3]}),
    ]
    rows = [(c, k, kind, {f: json.dumps(v) for f, v in fields.items()}) for c in range(10) for k, (kind, fields) in enumerate(opening)]
    start = t("orders").sparkSession.createDataFrame(rows, "cluster long, position long, kind string, fields map<string,string>")
    key, part, node = F.col("o_orderkey"), F.col("o_custkey") % 8 + 1, F.col("o_orderkey") % 6 + 1
    epoch = F.floor(F.col("o_orderkey") / 10) % 4 + 1
    text = lambda c: c.cast("string")
    pair = lambda a, b: F.concat(F.lit("["), text(a), F.lit(","), text(b), F.lit("]"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kinds = {
        "set_health": {"node": text(node), "health": F.when(F.col("o_orderstatus") == "P", '"dead"').otherwise('"healthy"')},
        "fence_partition": {"partition": text(part), "epoch": text(epoch)},
        "assign_owner": {
            "partition": text(part), "owner": text(node), "replicas": pair(node % 6 + 1, (node + 1) % 6 + 1),
            "epoch": text(epoch),
        },
        "begin_split": {
            "partition": text(part), "at": quoted(F.lpad(text(key % 1000), 3, "0")),
            "lower": text(key * 2 + 10), "upper": text(key * 2 + 11), "epoch": text(epoch),
        },
        "mark_split_prepared": {"partition": text(part), "node": text(node), "epoch": text(epoch)},
        "complete_split": {"partition": text(part), "epoch": text(epoch)},
        "set_replicas": {"partition": text(part), "replicas": pair(node % 6 + 1, (node + 2) % 6 + 1), "epoch": text(epoch)},
        "transfer_ownership": {
            "partition": text(part), "source": text(node % 6 + 1), "target": text((node + 1) % 6 + 1),
            "replicas": pair(node, node % 6 + 1), "epoch": text(epoch),
        },
    }
    which = F.floor(key / 4) % len(kinds)
    fields = F.coalesce(
        *[F.when(which == k, F.create_map(*[x for f, v in own.items() for x in (F.lit(f), v)])) for k, own in enumerate(kinds.values())]
    )
    kind = F.element_at(F.array(*map(F.lit, kinds)), (which + 1).cast("int"))
    return start.union(t("orders").select((F.col("o_custkey") % 10).alias("cluster"), (key + 1000).alias("position"), kind, fields))


@query("")
def command_outcomes(t):
    """What each command of the logs does: applied, or refused and why."""
    return cluster.outcomes(_commands(t)).groupBy("cluster", "kind", "outcome").agg(
        F.count("*").alias("n"), F.max("map_version").alias("map_version"),
    )
