"""Checks of histories and of results against each other."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import state as S
from tidemark.operators import verify as V
from tidemark.operators import writes as W
from tidemark.plans.registry import query
from tidemark.plans.writing import FOLD, requests

#: What each read of a register saw: the latest write that had returned, though every 31st read is stale.
READS = (
    "r AS (SELECT h.key, h.op_id, h.invoked, h.returned, max(w.version) AS seen FROM (SELECT * FROM op_history "
    "WHERE kind = 'read') h LEFT JOIN op_history w ON w.key = h.key AND w.kind = 'write' "
    "AND w.returned IS NOT NULL AND w.returned < h.invoked - CASE WHEN h.op_id % 31 = 0 THEN 3600000000 ELSE 0 END "
    "GROUP BY 1, 2, 3, 4)"
)


def reads(t):
    """Each read with the version it saw, by one pass a key in order of time."""
    history = t("op_history")
    late = F.when(F.col("op_id") % 31 == 0, 3_600_000_000).otherwise(0)
    writes = history.where("kind = 'write' AND returned IS NOT NULL").select(
        "key", F.col("returned").alias("at"), "version", F.lit(None).cast("long").alias("op_id"),
        F.lit(None).cast("long").alias("invoked"), F.lit(None).cast("long").alias("ended"),
    )
    asks = history.where("kind = 'read'").select(
        "key", (F.col("invoked") - late).alias("at"), F.lit(None).cast("long").alias("version"), "op_id",
        "invoked", F.col("returned").alias("ended"),
    )
    before = Window.partitionBy("key").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = writes.union(asks).withColumn("seen", F.max("version").over(before))
    return seen.where("op_id IS NOT NULL").select(
        "key", "op_id", "invoked", F.col("ended").alias("returned"), F.col("seen").alias("version"),
    )


@query("")
def linearizable_keys(t):
    """Whether each register's history has a legal order. Reads here see the latest acknowledged write, some an older one."""
    writes = t("op_history").where("kind = 'write'").select("key", "op_id", "kind", F.col("version").alias("value"), "invoked", "returned")
    seen = reads(t).select("key", "op_id", F.lit("read").alias("kind"), F.col("version").alias("value"), "invoked", "returned")
    return V.linearizable(writes.union(seen))


@query("op_history", (
    f"WITH {READS} SELECT r.key, r.op_id, r.seen, max(w.version) AS acknowledged FROM r JOIN op_history w "
    f"ON w.key = r.key AND w.kind = 'write' AND w.returned IS NOT NULL AND w.returned < r.invoked GROUP BY 1, 2, 3 "
    f"HAVING r.seen < max(w.version)"
))
def stale_reads(t):
    return V.stale_reads(reads(t), t("op_history").where("kind = 'write'"))


@query("mutation_log keyspaces", FOLD + (
    " SELECT q.keyspace_id, q.key, q.expected, count(*) AS wins FROM (SELECT * FROM o UNION ALL SELECT * FROM o "
    "WHERE lamport % 50 = 1) o JOIN q USING (keyspace_id, key, lamport) WHERE o.applied AND q.cond = 'if_version' "
    "GROUP BY 1, 2, 3 HAVING count(*) > 1"
))
def cas_uniqueness(t):
    """At most one swap may win against one version; a few wins are doubled here to be caught."""
    asked = requests(t)
    won = W.cas(asked).where("applied").select(*W.KEY, "lamport")
    won = won.union(won.where("lamport % 50 = 1"))
    swaps = asked.where("cond = 'if_version'").select(*W.KEY, "lamport", "expected").join(won, [*W.KEY, "lamport"])
    return swaps.groupBy(*W.KEY, "expected").agg(F.count("*").alias("wins")).where("wins > 1")


@query("mutations", (
    "SELECT keyspace_id, lamport, count(DISTINCT key) AS keys FROM (SELECT keyspace_id, lamport, key "
    "FROM mutations UNION ALL SELECT keyspace_id, lamport - lamport % 400, key FROM mutations "
    "WHERE lamport % 400 IN (0, 3)) GROUP BY 1, 2 HAVING count(DISTINCT key) > 1"
))
def version_reuse(t):
    """A lamport issued for two keys of one partition; some are reissued here to be caught."""
    log = t("mutations").select("keyspace_id", "lamport", "key")
    again = log.where("lamport % 400 IN (0, 3)").select("keyspace_id", (F.col("lamport") - F.col("lamport") % 400).alias("lamport"), "key")
    return log.union(again).groupBy("keyspace_id", "lamport").agg(F.count_distinct("key").alias("keys")).where("keys > 1")


@query("mutation_log", (
    "WITH m AS (SELECT keyspace_id, max(now_millis) FILTER (op = 'delete') AS quiet FROM mutation_log GROUP BY 1) "
    "SELECT m.keyspace_id, m.quiet, min(l.now_millis) AS met, min(l.now_millis) - m.quiet <= 7200000 AS converged "
    "FROM m LEFT JOIN mutation_log l ON l.keyspace_id = m.keyspace_id AND l.now_millis > m.quiet AND l.op = 'put' "
    "AND l.cond = 'none' GROUP BY 1, 2"
).replace("min(l.now_millis) - m.quiet <= 7200000 AS", "coalesce(min(l.now_millis) - m.quiet <= 7200000, FALSE) AS"))
def convergence_time(t):
    """When, after the last fault (a delete here), all is well again (a plain put), and whether within the bound."""
    log = t("mutation_log")
    quiet = log.groupBy("keyspace_id").agg(F.max(F.when(F.col("op") == "delete", F.col("now_millis"))).alias("quiet"))
    well = log.where("op = 'put' AND cond = 'none'").join(F.broadcast(quiet), "keyspace_id").where("now_millis > quiet").groupBy("keyspace_id").agg(F.min("now_millis").alias("met"))
    return quiet.join(well, "keyspace_id", "left").withColumn(
        "converged", F.coalesce(F.col("met") - F.col("quiet") <= 7_200_000, F.lit(False)),
    )


@query("mutations", (
    "WITH n AS (SELECT keyspace_id, key, max(lamport) AS version FROM mutations WHERE lamport % 401 <> 7 "
    "GROUP BY 1, 2) SELECT m.keyspace_id, m.key, max(m.lamport) AS lost FROM mutations m LEFT "
    "JOIN n USING (keyspace_id, key) WHERE n.version IS NULL OR m.lamport > n.version GROUP BY 1, 2"
))
def lost_acks(t):
    """Acknowledged writes that the state after a failover (one in 401 is lost) does not reach."""
    acked = t("mutations").groupBy(*S.KEY).agg(F.max("lamport").alias("lost"))
    after = S.replay(t("mutations").where("lamport % 401 <> 7")).select(*S.KEY, "version")
    return acked.join(after, S.KEY, "left").where("version IS NULL OR lost > version").drop("version")
