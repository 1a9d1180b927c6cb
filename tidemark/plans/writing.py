"""Conditional writes, locks, fencing and what their outcomes say."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import state as S
from tidemark.operators import writes as W
from tidemark.plans.registry import query

USES = "mutation_log keyspaces"
REQUESTS = """q AS (SELECT m.keyspace_id, m.key, m.lamport, m.op, m.cond, m.expected, m.now_millis, CASE
  WHEN m.op = 'put' THEN m.now_millis + coalesce(m.ttl_millis, k.default_ttl_millis) END AS expires,
    row_number() OVER (PARTITION BY m.keyspace_id, m.key ORDER BY m.lamport) AS n FROM mutation_log m JOIN keyspaces k USING (keyspace_id)
      WHERE m.op <> 'get')"""
FOLD = f"""WITH RECURSIVE {REQUESTS},
  f AS (SELECT keyspace_id, key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS lamport, '' AS op, CAST(0 AS BIGINT) AS version,
    CAST(NULL AS BIGINT) AS expires, TRUE AS applied, CAST(0 AS BIGINT) AS found, CAST(0 AS BIGINT) AS written FROM q WHERE n = 1
    UNION ALL SELECT keyspace_id, key, n, lamport, op, CASE WHEN writes AND op = 'put' THEN lamport WHEN writes THEN 0 ELSE version END,
      CASE WHEN writes AND op = 'put' THEN expires WHEN writes THEN NULL ELSE held_until END, held, found, CASE WHEN writes THEN lamport
      ELSE 0 END
    FROM (SELECT *, held AND (op = 'put' OR found > 0) AS writes FROM (SELECT *, CASE cond WHEN 'if_not_present' THEN found = 0
      WHEN 'if_version' THEN found IS NOT DISTINCT FROM expected ELSE TRUE END AS held
      FROM (SELECT q.*, f.version, f.expires AS held_until, CASE WHEN f.version = 0 OR coalesce(q.now_millis >= f.expires, FALSE) THEN 0
        ELSE f.version END AS found FROM f JOIN q ON q.keyspace_id = f.keyspace_id AND q.key = f.key AND q.n = f.n + 1)))),
  o AS (SELECT keyspace_id, key, lamport, op, applied, found AS found_version, written AS new_version FROM f WHERE n > 0)"""


def requests(t):
    """The write requests of the log, each with the expiry it asks for."""
    rows = t("mutation_log").where("op <> 'get'").join(
        F.broadcast(t("keyspaces").select("keyspace_id", "default_ttl_millis")), "keyspace_id",
    )
    expires = F.when(F.col("op") == "put", S.saturating_expiry(F.col("now_millis"), F.coalesce("ttl_millis", "default_ttl_millis")))
    return rows.select("keyspace_id", "key", "lamport", "op", "cond", "expected", expires.alias("expires_at_millis"), "now_millis")


@query(USES, FOLD + " SELECT * FROM o")
def cas_fold(t):
    return W.cas(requests(t))


@query(USES, FOLD + (
    " SELECT keyspace_id, op, count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied) AS lost, "
    "count(*) FILTER (new_version > 0) AS written FROM o GROUP BY 1, 2"
))
def cas_outcomes(t):
    return W.cas(requests(t)).groupBy("keyspace_id", "op").agg(
        F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("lost"),
        F.count_if(F.col("new_version") > 0).alias("written"),
    )


#: In one line, so that parts can be replaced.
FLAT = " ".join(FOLD.split())
STORED = FLAT.replace((
    "SELECT keyspace_id, key, n, lamport, op, CASE WHEN writes AND op = 'put' THEN lamport WHEN writes THEN 0 "
    "ELSE version END, CASE WHEN writes AND op = 'put' THEN expires WHEN writes THEN NULL ELSE held_until END, "
    "held, found, CASE WHEN writes THEN lamport ELSE 0 END"
),
    # A version below zero is that of a tombstone.
    (
        "SELECT keyspace_id, key, n, lamport, op, CASE WHEN writes AND op = 'put' THEN lamport "
        "WHEN writes THEN -lamport ELSE version END, CASE WHEN writes AND op = 'put' THEN expires "
        "WHEN writes THEN now_millis + 86400000 ELSE held_until END, held, CASE WHEN held AND NOT writes THEN -version "
        "ELSE found END, CASE WHEN writes THEN lamport ELSE 0 END"
    ))
STORED = STORED.replace(
    "held AND (op = 'put' OR found > 0) AS writes",
    "held AND (op = 'put' OR version >= 0 OR now_millis >= held_until) AS writes",
).replace("CASE WHEN f.version = 0 OR", "CASE WHEN f.version <= 0 OR")


@query(USES, STORED + " SELECT * FROM o")
def storage_fold(t):
    """The same requests by the storage layer's rules: a delete writes a tombstone for a day even where nothing is, and finds a standing one."""
    return W.cas(requests(t), "storage")


LOCK = (
    "CASE WHEN op = 'delete' THEN 'none' ELSE 'if_not_present' END AS cond, CASE "
    "WHEN op = 'put' THEN now_millis + 7200000 END AS expires"
)
LOCKS = FLAT.replace((
    "m.lamport, m.op, m.cond, m.expected, m.now_millis, CASE "
    "WHEN m.op = 'put' THEN m.now_millis + coalesce(m.ttl_millis, k.default_ttl_millis) END AS expires"
), "m.lamport, m.op, m.expected, m.now_millis, " + LOCK.replace("op ", "m.op ").replace("now_millis", "m.now_millis"))


@query(USES, LOCKS + (
    " SELECT keyspace_id, key, new_version AS token, lead(lamport) OVER (PARTITION BY keyspace_id, key "
    "ORDER BY lamport) AS next_change FROM o WHERE new_version > 0 AND op = 'put'"
))
def lock_timeline(t):
    """Each put as an attempt at a two-hour lock: who held it, under which fencing token, and who came next."""
    put = F.col("op") == "put"
    tries = requests(t).withColumn("cond", F.when(put, "if_not_present").otherwise("none")).withColumn(
        "expires_at_millis", F.when(put, F.col("now_millis") + 7_200_000),
    )

    after = F.lead("lamport").over(Window.partitionBy(*W.KEY).orderBy("lamport"))
    return W.cas(tries).where("new_version > 0 AND op = 'put'").select(
        *W.KEY, F.col("new_version").alias("token"), after.alias("next_change"),
    )


@query(USES, FOLD + (
    " SELECT o.keyspace_id, o.key, o.lamport, q.expected, o.found_version FROM o JOIN q USING (keyspace_id, key, "
    "lamport) WHERE q.cond = 'if_version' AND NOT o.applied"
))
def fenced_writes(t):
    """Guarded writes that lost: their token was no longer the record's version."""
    asked = requests(t)
    lost = W.cas(asked).where("NOT applied").select(*W.KEY, "lamport", "found_version")
    return asked.where("cond = 'if_version'").join(lost, [*W.KEY, "lamport"]).select(*W.KEY, "lamport", "expected", "found_version")


@query("mutation_log", """SELECT c.keyspace_id, c.lamport, count(*) AS in_flight FROM mutation_log c
  JOIN mutation_log w ON w.keyspace_id = c.keyspace_id AND w.key = c.key AND w.op <> 'get' AND w.lamport < c.lamport
  AND w.now_millis + 3000000 > c.now_millis
  WHERE c.op <> 'get' AND c.cond <> 'none' GROUP BY 1, 2""")
def undecided_conditions(t):
    """Conditions asked while an earlier write of the key is in flight (here for 50 minutes): neither true nor false yet.

    The interval join is by key and by time bucket of a flight's length, so a hot key's pairs stay within two buckets.
    """
    flight = 3_000_000
    log = t("mutation_log").where("op <> 'get'")
    asked = log.where("cond <> 'none'").select(
        *W.KEY, "lamport", F.col("now_millis").alias("asked_at"),
        F.explode(F.sequence(F.floor(F.col("now_millis") / flight) - 1, F.floor(F.col("now_millis") / flight))).alias("bucket"),
    )
    written = log.select(
        *W.KEY, F.col("lamport").alias("earlier"), F.col("now_millis").alias("sent_at"),
        F.floor(F.col("now_millis") / flight).alias("bucket"),
    )
    met = asked.join(written, [*W.KEY, "bucket"]).where((F.col("earlier") < F.col("lamport")) & (F.col("sent_at") + flight > F.col("asked_at")))
    return met.groupBy("keyspace_id", "lamport").agg(F.count("*").alias("in_flight"))
