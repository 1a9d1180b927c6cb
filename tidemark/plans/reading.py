"""Scans, reads, predicates and limits; the state they read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.keys import in_prefix
from tidemark.operators import ordered as O
from tidemark.operators import state as S
from tidemark.plans.registry import Tables, query

NOW = "(SELECT max(now_millis) FROM mutation_log)"
STATE = (
    "state AS (SELECT keyspace_id, key, max(lamport) AS version, max_by(deleted, lamport) AS deleted, "
    "max_by(value_bytes, lamport) AS value_bytes, arg_max_null(expires_at_millis, lamport) AS expires_at_millis "
    "FROM mutations GROUP BY 1, 2)"
)
#: Live rows of the state at the log's latest time.
LIVE = f"NOT deleted AND (expires_at_millis IS NULL OR expires_at_millis > {NOW})"
USES = "mutation_log mutations"


def state_sql(body: str) -> str:
    return "WITH " + STATE + (", " + body[5:] if body.startswith("WITH ") else " " + body)


def _now(t: Tables):
    return S.clock(t("mutation_log"))


@query(USES, state_sql((
    f"SELECT keyspace_id, key, version, value_bytes, expires_at_millis FROM state WHERE keyspace_id = 2 "
    f"AND key = 'u/000002/1' AND {LIVE}"
)))
def kv_get(t):
    """Point read: the key reaches the scan's filter before anything is grouped."""
    own = t("mutations").where("keyspace_id = 2 AND key = 'u/000002/1'")
    return S.live(S.replay(own), _now(t)).drop("deleted")


@query(USES, state_sql(f"""WITH wanted AS (SELECT DISTINCT user_id % 5 AS keyspace_id, concat('u/',
  lpad(CAST(user_id AS VARCHAR), 6, '0'), '/0') AS key FROM events)
  SELECT w.keyspace_id, w.key, s.key IS NOT NULL AS found, s.version, s.value_bytes, s.expires_at_millis FROM wanted w LEFT JOIN (SELECT *
    FROM state WHERE {LIVE}) s ON w.keyspace_id = s.keyspace_id AND w.key = s.key"""))
def kv_multi_get(t):
    wanted = t("events").select(
        (F.col("user_id") % 5).alias("keyspace_id"),
        F.concat(F.lit("u/"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("/0")).alias("key"),
    ).distinct()
    return S.multi_get(wanted, S.replay(t("mutations")), _now(t))


@query(USES, f"""WITH lim AS (SELECT keyspace_id, max(lamport) - 200 AS horizon FROM mutations GROUP BY 1),
  r AS (SELECT m.*, row_number() OVER (PARTITION BY m.keyspace_id, key ORDER BY lamport DESC) AS n, lamport > horizon AS pending
    FROM mutations m JOIN lim USING (keyspace_id))
  SELECT keyspace_id, key, lamport AS version, value_bytes, pending FROM r WHERE n = 1 AND {LIVE}""")
def overlay_get(t):
    """Reads over the committed state and the last 200 lamports of each keyspace still in flight."""
    log = t("mutations")
    horizon = log.groupBy("keyspace_id").agg((F.max("lamport") - 200).alias("horizon"))
    log = log.join(F.broadcast(horizon), "keyspace_id")  # a row a keyspace of a configured list
    merged = S.overlay(S.replay(log.where("lamport <= horizon")), log.where("lamport > horizon"), _now(t))
    return merged.join(F.broadcast(horizon), "keyspace_id").select(
        *S.KEY, "version", "value_bytes", (F.col("version") > F.col("horizon")).alias("pending"),
    )


@query(USES, state_sql((
    f"SELECT keyspace_id, key, version, value_bytes FROM state WHERE key >= 'u/0000' AND key < 'u/0001' "
    f"AND keyspace_id = 3 AND {LIVE}"
)))
def list_prefix(t):
    own = t("mutations").where("keyspace_id = 3").where(in_prefix(F.col("key"), "u/0000"))
    return S.live(S.replay(own), _now(t)).select(*S.KEY, "version", "value_bytes").orderBy("key")


@query(USES, state_sql((
    f"SELECT keyspace_id, key, version, (row_number() OVER (PARTITION BY keyspace_id "
    f"ORDER BY key) - 1) // 7 AS page FROM state WHERE {LIVE}"
)))
def list_pages(t):
    return S.pages(S.live(S.replay(t("mutations")), _now(t)), 7, ["keyspace_id"]).select(*S.KEY, "version", "page")


@query(USES, state_sql(f"""WITH RECURSIVE e AS (SELECT keyspace_id, key, length(key) + value_bytes AS size,
  row_number() OVER (PARTITION BY keyspace_id ORDER BY key) AS n FROM state WHERE {LIVE}),
  f AS (SELECT keyspace_id, key, n, size AS bytes, 1 AS own, 0 AS page FROM e WHERE n = 1 UNION ALL
    SELECT e.keyspace_id, e.key, e.n, CASE WHEN f.bytes + e.size > 60000 OR f.own >= 12 THEN e.size ELSE f.bytes + e.size END, CASE
      WHEN f.bytes + e.size > 60000 OR f.own >= 12 THEN 1 ELSE f.own + 1 END, CASE WHEN f.bytes + e.size > 60000
      OR f.own >= 12 THEN f.page + 1 ELSE f.page END
    FROM f JOIN e ON e.keyspace_id = f.keyspace_id AND e.n = f.n + 1)
  SELECT keyspace_id, key, CAST(page AS BIGINT) AS page FROM f"""))
def list_pages_bytes(t):
    rows = S.live(S.replay(t("mutations")), _now(t))
    return S.pages_by_bytes(rows, 60_000, 12, ["keyspace_id"], F.octet_length("key") + F.col("value_bytes")).select(*S.KEY, "page")


@query(USES, state_sql(f"SELECT keyspace_id, key, version, expires_at_millis FROM state WHERE {LIVE}"))
def list_keys_only(t):
    return S.live(S.replay(t("mutations")), _now(t)).select(*S.KEY, "version", "expires_at_millis")


@query(USES, state_sql((
    f"SELECT keyspace_id, key, version FROM state WHERE keyspace_id = 1 AND key > 'u/000041/2' AND {LIVE} "
    f"ORDER BY key LIMIT 20"
)))
def list_after_cursor(t):
    """The page after a key: keyset paging, taken ordered without a full sort."""
    own = t("mutations").where("keyspace_id = 1 AND key > 'u/000041/2'")
    return S.live(S.replay(own), _now(t)).select(*S.KEY, "version").orderBy("key").limit(20)


@query(
    USES,
    state_sql(f"SELECT keyspace_id, count(*) AS live, CAST(sum(value_bytes) AS BIGINT) AS bytes FROM state WHERE {LIVE} GROUP BY 1"),
)
def live_keys(t):
    return S.live(S.replay(t("mutations")), _now(t)).groupBy("keyspace_id").agg(
        F.count("*").alias("live"), F.sum("value_bytes").alias("bytes"),
    )


@query(USES, state_sql(f"SELECT keyspace_id, key, version, deleted FROM state WHERE NOT ({LIVE})"))
def reclaimable_keys(t):
    return S.reclaimable(S.replay(t("mutations")), _now(t)).select(*S.KEY, "version", "deleted")


@query("keyspaces", """SELECT name, least(coalesce(max_value_bytes, 262144), 262144) AS max_value_bytes,
  greatest(least(coalesce(max_value_bytes, 262144), 262144), 4194304) + 65536 AS message_bytes FROM keyspaces
  UNION ALL SELECT '*', least(coalesce(max(max_value_bytes), 262144), 262144),
    greatest(least(coalesce(max(max_value_bytes), 262144), 262144), 4194304) + 65536 FROM keyspaces""")
def limits_effective(t):
    """Limits of each keyspace, and of a client that names none: the largest configured."""
    ceiling, page, overhead = 262_144, 4_194_304, 65_536
    each = t("keyspaces").select("name", "max_value_bytes")
    every = each.agg(F.max("max_value_bytes").alias("max_value_bytes")).select(F.lit("*").alias("name"), "max_value_bytes")
    value = F.least(F.coalesce("max_value_bytes", F.lit(ceiling)), F.lit(ceiling)).cast("long")
    return each.union(every).select(
        "name", value.alias("max_value_bytes"),
        (F.greatest(value, F.lit(page)) + overhead).alias("message_bytes"),
    )


@query("mutation_log keyspaces", """SELECT m.lamport, CASE WHEN NOT regexp_full_match(k.name, '[a-z][a-z0-9_-]{0,63}') THEN 'keyspace name'
  WHEN octet_length(encode(m.key)) > 10240 OR m.key = '' THEN 'key size'
  WHEN m.value_bytes > least(coalesce(k.max_value_bytes, 262144), 262144) THEN 'value size'
    WHEN m.cond = 'if_version' AND m.expected IS NULL THEN 'condition' END AS fault FROM mutation_log m
      JOIN keyspaces k USING (keyspace_id) WHERE m.op = 'put' AND fault IS NOT NULL""")
def validate_requests(t):
    """Requests that go to quarantine, with the first rule they break."""
    limit = F.least(F.coalesce("max_value_bytes", F.lit(262_144)), F.lit(262_144))
    fault = (
        F.when(~F.col("name").rlike("^[a-z][a-z0-9_-]{0,63}$"), "keyspace name").when(
            (F.octet_length("key") > 10_240) | (F.col("key") == ""), "key size",
        )
        .when(F.col("value_bytes") > limit, "value size").when((F.col("cond") == "if_version") & F.col("expected").isNull(), "condition")
    )
    rows = t("mutation_log").where("op = 'put'").join(
        F.broadcast(t("keyspaces").select("keyspace_id", "name", "max_value_bytes")), "keyspace_id",
    )
    return rows.select("lamport", fault.alias("fault")).where("fault IS NOT NULL")


# The status that a client sees for each kind of error, and whether it may try again.
STATUS = (
    ("not_found", "NOT_FOUND", False), ("already_exists", "ALREADY_EXISTS", False), ("version_mismatch", "FAILED_PRECONDITION", False), ("not_owner", "UNAVAILABLE", True), ("stale_epoch", "UNAVAILABLE", True),
    ("unavailable", "UNAVAILABLE", True), ("too_large", "INVALID_ARGUMENT", False), ("invalid_argument", "INVALID_ARGUMENT", False), ("quota_exceeded", "RESOURCE_EXHAUSTED", True), ("unauthenticated", "UNAUTHENTICATED", False),
    ("permission_denied", "PERMISSION_DENIED", False), ("indeterminate", "UNKNOWN", False), ("internal", "INTERNAL", False),
)


@query("", """SELECT status, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE event_type WHEN 'error' THEN CASE
  WHEN event_id % 3 = 0 THEN 'UNAVAILABLE' WHEN event_id % 3 = 1 THEN 'UNKNOWN' ELSE 'INVALID_ARGUMENT' END
  WHEN 'signup' THEN 'ALREADY_EXISTS' WHEN 'purchase' THEN 'FAILED_PRECONDITION' ELSE 'OK' END AS status, count(*) AS n FROM events GROUP BY 1) GROUP BY 1""")
def status_codes(t):
    kind = F.when(
        F.col("event_type") == "error",
        F.element_at(F.array(*map(F.lit, ("stale_epoch", "indeterminate", "too_large"))), (F.col("event_id") % 3 + 1).cast("int")),
    ).when(F.col("event_type") == "signup", "already_exists").when(F.col("event_type") == "purchase", "version_mismatch")
    events = t("events").select(kind.alias("kind"))
    lookup = events.sparkSession.createDataFrame(STATUS, "kind string, status string, retryable boolean")
    return events.join(F.broadcast(lookup), "kind", "left").groupBy(F.coalesce("status", F.lit("OK")).alias("status")).agg(F.count("*").alias("n"))


@query("", """SELECT user_id % 5 AS keyspace_id, count(*) FILTER (event_type = 'view') AS hits,
  count(*) FILTER (event_type = 'click') AS misses, CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) > 0
  THEN count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'click')) END AS hit_rate FROM events GROUP BY 1""")
def cache_hit_rate(t):
    """Null, not zero, where nothing was read."""
    hits, misses = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click")
    return t("events").groupBy((F.col("user_id") % 5).alias("keyspace_id")).agg(
        hits.alias("hits"), misses.alias("misses"), F.try_divide(hits, hits + misses).alias("hit_rate"),
    )


@query(USES, state_sql("SELECT * FROM state"))
def replay_state(t):
    return S.replay(t("mutations"))


@query(USES, state_sql("SELECT * FROM state"))
def replay_from_horizon(t):
    """A base at half the log and the rest above it give the whole state, though part of the log is delivered again."""
    log = t("mutations")
    half = log.agg((F.max("lamport") / 2).cast("long")).first()[0]
    base = S.replay(log.where(F.col("lamport") <= half))
    return S.replay_above(base, log.where(F.col("lamport") > half - 500), half)


@query(USES, (
    "SELECT keyspace_id, count(*) AS delivered, count(DISTINCT lamport) AS applied FROM (SELECT * FROM mutations "
    "UNION ALL SELECT * FROM mutations WHERE lamport % 3 = 0) GROUP BY 1"
))
def dedup_log(t):
    """Deliveries against the mutations that they are: the same lamport again is a no-op."""
    log = t("mutations")
    delivered = log.union(log.where("lamport % 3 = 0")).groupBy("keyspace_id", "lamport").agg(F.count("*").alias("n"))
    return delivered.groupBy("keyspace_id").agg(F.sum("n").alias("delivered"), F.count("*").alias("applied"))


@query(USES, """SELECT keyspace_id, lamport, before FROM (SELECT keyspace_id, lamport,
  lag(lamport) OVER (PARTITION BY keyspace_id ORDER BY arrival) AS before
  FROM (SELECT keyspace_id, lamport, CASE WHEN lamport % 101 = 0 THEN lamport + 40 ELSE lamport END * 2 + CASE
    WHEN lamport % 101 = 0 THEN 1 ELSE 0 END AS arrival FROM mutations)) WHERE lamport <= before""")
def lamport_regressions(t):
    """Writes that arrive with a lamport not above the one before (some are delayed here)."""
    late = F.col("lamport") % 101 == 0
    arrival = F.when(late, F.col("lamport") + 40).otherwise(F.col("lamport")) * 2 + F.when(late, 1).otherwise(0)
    rows = t("mutations").select("keyspace_id", "lamport", arrival.alias("arrival"))
    return O.before(rows, ["keyspace_id"], ["arrival"], {"before": (O.LAST, "lamport")}).where("lamport <= before").drop("arrival")


@query("mutation_log keyspaces", (
    "SELECT lamport, CASE WHEN m.lamport % 1000 = 0 THEN 9223372036854775807 "
    "ELSE now_millis + coalesce(ttl_millis, default_ttl_millis) END AS expires_at_millis FROM mutation_log m "
    "JOIN keyspaces USING (keyspace_id) WHERE op = 'put'"
))
def resolve_expiry(t):
    """The request's time to live, else the keyspace's; every thousandth asks for more than time holds."""
    rows = t("mutation_log").where("op = 'put'").join(
        F.broadcast(t("keyspaces").select("keyspace_id", "default_ttl_millis")), "keyspace_id",
    )
    ttl = F.when(F.col("lamport") % 1000 == 0, F.lit(S.MAX_LONG)).otherwise(F.coalesce("ttl_millis", "default_ttl_millis"))
    return rows.select("lamport", S.saturating_expiry(F.col("now_millis"), ttl).alias("expires_at_millis"))


@query(USES, "SELECT keyspace_id, max(lamport) AS committed FROM mutations GROUP BY 1")
def committed_horizon(t):
    return t("mutations").groupBy("keyspace_id").agg(F.max("lamport").alias("committed"))


@query("mutations segments", state_sql((
    "SELECT s.keyspace_id, CAST(sum(length(key) + value_bytes + 64) AS BIGINT) AS memory_bytes, "
    "CAST(max(g.bytes) AS BIGINT) AS segment_bytes FROM state s JOIN (SELECT keyspace_id, sum(bytes) AS bytes "
    "FROM segments GROUP BY 1) g ON s.keyspace_id = g.keyspace_id GROUP BY 1"
)))
def partition_size(t):
    memory = S.replay(t("mutations")).groupBy("keyspace_id").agg(F.sum(S.footprint(F.col("key"), F.col("value_bytes"))).alias("memory_bytes"))
    return memory.join(t("segments").groupBy("keyspace_id").agg(F.sum("bytes").alias("segment_bytes")), "keyspace_id")


@query("segment_records", (
    "SELECT keyspace_id, CAST(sum(length(key) + 64) AS BIGINT) AS index_bytes, count(*) AS keys "
    "FROM (SELECT DISTINCT keyspace_id, key FROM segment_records) GROUP BY 1"
))
def index_bytes(t):
    keys = t("segment_records").select(*S.KEY).distinct()
    return keys.groupBy("keyspace_id").agg(F.sum(F.octet_length("key") + 64).cast("long").alias("index_bytes"), F.count("*").alias("keys"))


@query(USES, (
    "SELECT keyspace_id, key, lamport, lamport - lag(lamport) OVER (PARTITION BY keyspace_id, key "
    "ORDER BY lamport) AS gap FROM mutations"
))
def version_gaps(t):
    """A key's versions only rise and need not be dense."""
    before = F.lag("lamport").over(Window.partitionBy(*S.KEY).orderBy("lamport"))
    return t("mutations").select(*S.KEY, "lamport", (F.col("lamport") - before).alias("gap"))
