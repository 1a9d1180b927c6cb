"""Routing and range-partition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import control as C
from tidemark.operators import lsm as L
from tidemark.operators import ranges as R
from tidemark.operators import state as S
from tidemark.plans.registry import query

ROUTED = (
    "k AS (SELECT CAST(n.n_regionkey AS BIGINT) AS keyspace_id, n.n_name || '/' || c.c_name AS key FROM customer c "
    "JOIN nation n ON c.c_nationkey = n.n_nationkey)"
)
ROUTE = "k.keyspace_id = p.keyspace_id AND k.key >= p.start_key AND (p.end_key IS NULL OR k.key < p.end_key)"


def customer_keys(t):
    nations = F.broadcast(t("nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("keyspace_id"), "n_name"))  # 25 rows
    return t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "keyspace_id", F.concat("n_name", F.lit("/"), "c_name").alias("key"),
    )


@query("partition_map", (
    f"WITH {ROUTED} SELECT p.keyspace_id, p.partition_id, count(*) AS keys, min(k.key) AS first_key FROM k "
    f"JOIN partition_map p ON {ROUTE} GROUP BY 1, 2"
))
def route_keys(t):
    return R.route(customer_keys(t), t("partition_map")).groupBy("keyspace_id", "partition_id").agg(F.count("*").alias("keys"), F.min("key").alias("first_key"))


@query("broken_map", (
    f"WITH {ROUTED} SELECT k.keyspace_id, count(*) AS lost FROM k WHERE NOT EXISTS (SELECT 1 FROM broken_map p "
    f"WHERE {ROUTE}) GROUP BY 1"
))
def unrouted_keys(t):
    keys = customer_keys(t)
    routed = R.route(keys, t("broken_map")).select("keyspace_id", "key").distinct()
    return keys.join(routed, ["keyspace_id", "key"], "left_anti").groupBy("keyspace_id").agg(F.count("*").alias("lost"))


@query("mutations segment_records", (
    "WITH b AS (SELECT keyspace_id, key, lamport, deleted, sequence FROM segment_records WHERE sequence < 5 "
    "UNION ALL SELECT keyspace_id, key, lamport, deleted, -1 FROM mutations WHERE lamport > 5000) "
    "SELECT keyspace_id, key, max(lamport) AS version, max_by(deleted, lamport) AS deleted, max_by(sequence, "
    "lamport) = -1 AS from_memory FROM b GROUP BY 1, 2"
))
def merge_memtable(t):
    """The memtable laid over the runs below it: one union and one fold, the newer side shadows."""
    runs = t("segment_records").where("sequence < 5").select(*S.KEY, "lamport", "deleted", F.lit(False).alias("from_memory"))
    both = runs.union(t("mutations").where("lamport > 5000").select(*S.KEY, "lamport", "deleted", F.lit(True)))
    return both.groupBy(*S.KEY).agg(
        F.max("lamport").alias("version"), F.max_by("deleted", "lamport").alias("deleted"),
        F.max_by("from_memory", "lamport").alias("from_memory"),
    )


@query("partition_map replicas node_status", """SELECT p.partition_id, p.owner, o.committed, o.size_bytes, o.index_bytes,
  r.node_id AS replica, s.durable, s.applied FROM partition_map p LEFT JOIN node_status o ON o.partition_id = p.partition_id
  AND o.node_id = p.owner
  LEFT JOIN replicas r ON r.partition_id = p.partition_id LEFT JOIN node_status s ON s.partition_id = r.partition_id
    AND s.node_id = r.node_id""")
def cluster_partitions(t):
    """Partitions with their owner's report and each replica's position; what nobody reported stays null."""
    own = t("node_status").select("partition_id", F.col("node_id").alias("owner"), "committed", "size_bytes", "index_bytes")
    held = t("replicas").select("partition_id", F.col("node_id").alias("replica"))
    position = t("node_status").select("partition_id", F.col("node_id").alias("replica"), "durable", "applied")
    return t("partition_map").select("partition_id", "owner").join(own, ["partition_id", "owner"], "left").join(held, "partition_id", "left").join(position, ["partition_id", "replica"], "left").select(
        "partition_id", "owner", "committed", "size_bytes", "index_bytes", "replica", "durable", "applied",
    )


@query("partition_map replicas", (
    "SELECT node_id, count(*) AS held, count(*) FILTER (owned) AS owned FROM (SELECT owner AS node_id, "
    "TRUE AS owned FROM partition_map WHERE owner IS NOT NULL UNION ALL SELECT node_id, FALSE FROM replicas) "
    "GROUP BY 1"
))
def held_by(t):
    return C.held(t("partition_map"), t("replicas"))


@query(
    "mutations segments",
    """SELECT q.keyspace_id, q.key, count(s.name) AS candidates, arg_max(s.name, s.max_lamport) AS newest
      FROM (SELECT DISTINCT keyspace_id, key FROM mutations) q LEFT JOIN segments s ON s.keyspace_id = q.keyspace_id AND s.min_key <= q.key
      AND q.key <= s.max_key GROUP BY 1, 2""",
)
def segment_candidates(t):
    """Runs whose key bounds may hold a key: file skipping by zone map."""
    return L.candidate_runs(t("mutations").select(*S.KEY).distinct(), t("segments")).select(*S.KEY, "candidates", "newest")


@query("broken_map", """WITH o AS (SELECT *, lag(end_key) OVER w AS before, row_number() OVER w = 1 AS first,
  lead(start_key) OVER w IS NULL AS last FROM broken_map WINDOW w AS (PARTITION BY keyspace_id ORDER BY start_key, partition_id))
  SELECT keyspace_id, partition_id, 'gap_at_start' AS error, '' AS at FROM o WHERE first AND start_key <> '' UNION ALL SELECT keyspace_id,
    partition_id, 'overlap', start_key FROM o WHERE NOT first AND (before IS NULL OR before > start_key)
  UNION ALL SELECT keyspace_id, partition_id, 'gap', before FROM o WHERE NOT first AND before < start_key UNION ALL SELECT keyspace_id,
    partition_id, 'gap_at_end', end_key FROM o WHERE last AND end_key IS NOT NULL""")
def coverage_errors(t):
    return R.coverage_errors(t("broken_map"))


@query("partition_map", """WITH s AS (SELECT *, CASE WHEN start_key = '' THEN 'C' ELSE start_key || 'M' END AS cut FROM partition_map),
  i AS (SELECT * FROM s WHERE cut > start_key AND (end_key IS NULL OR cut < end_key))
  SELECT keyspace_id, partition_id, 'lower' AS side, start_key AS child_start, cut AS child_end FROM i UNION ALL SELECT keyspace_id,
    partition_id, 'upper', cut, end_key FROM i""")
def split_ranges(t):
    return R.split(t("partition_map"), F.when(F.col("start_key") == "", "C").otherwise(F.concat("start_key", F.lit("M"))))


@query("partition_map", (
    "SELECT a.keyspace_id, a.partition_id AS lower, b.partition_id AS upper, a.end_key AS meet "
    "FROM partition_map a JOIN partition_map b ON a.keyspace_id = b.keyspace_id AND a.end_key = b.start_key"
))
def mergeable_pairs(t):
    return R.adjacent(t("partition_map"))


@query("partition_map", (
    "SELECT keyspace_id, partition_id, hex(start_key) || '00' AS split_key_hex FROM partition_map "
    "WHERE end_key IS NULL OR hex(start_key) || '00' < hex(end_key)"
))
def suggest_split(t):
    """The least key above the start, as hex; none where the range has no room for it."""
    key = F.concat(F.col("start_key").cast("binary"), F.unhex(F.lit("00")))
    return t("partition_map").where(F.col("end_key").isNull() | (key < F.col("end_key").cast("binary"))).select(
        "keyspace_id", "partition_id", F.hex(key).alias("split_key_hex"),
    )


CHILD = "CASE WHEN key < 'u/000050' THEN 'lower' ELSE 'upper' END"
WON = (
    "WITH won AS (SELECT keyspace_id, key, max(lamport) AS lamport, max_by(sequence, lamport) AS sequence "
    "FROM segment_records GROUP BY 1, 2)"
)


@query("segment_records segments", (
    f"{WON} SELECT w.keyspace_id, {CHILD} AS child, w.sequence, count(*) AS winners, min(w.key) AS min_key, "
    f"max(w.key) AS max_key, any_value(s.min_lamport) AS min_lamport, any_value(s.max_lamport) AS max_lamport "
    f"FROM won w JOIN segments s USING (keyspace_id, sequence) GROUP BY 1, 2, 3"
))
def split_child_segments(t):
    """A child lists the parent's runs that still hold winners in its range: key bounds shrink, lamport bounds stay."""
    child = F.when(F.col("key") < "u/000050", "lower").otherwise("upper").alias("child")
    shares = L.winners(t("segment_records")).groupBy("keyspace_id", child, "sequence").agg(
        F.count("*").alias("winners"), F.min("key").alias("min_key"), F.max("key").alias("max_key"),
    )
    return shares.join(t("segments").select("keyspace_id", "sequence", "min_lamport", "max_lamport"), ["keyspace_id", "sequence"])


@query("segment_records segments", (
    f"{WON}, c AS (SELECT w.keyspace_id, {CHILD} AS child, s.name, s.record_count, min(w.key) AS min_key, "
    f"max(w.key) AS max_key FROM won w JOIN segments s USING (keyspace_id, sequence) GROUP BY 1, 2, 3, 4) "
    f"SELECT keyspace_id, name, any_value(record_count) AS record_count, min(min_key) AS min_key, "
    f"max(max_key) AS max_key, count(*) AS parents FROM c GROUP BY 1, 2"
))
def merge_child_segments(t):
    """Both parents' lists as one: a run listed by both is one entry with the wider bounds."""
    listed = split_child_segments(t).select("keyspace_id", "sequence", "min_key", "max_key").join(
        t("segments").select("keyspace_id", "sequence", "name", "record_count"), ["keyspace_id", "sequence"],
    )
    return listed.groupBy("keyspace_id", "name").agg(
        F.any_value("record_count").alias("record_count"), F.min("min_key").alias("min_key"),
        F.max("max_key").alias("max_key"), F.count("*").alias("parents"),
    )


HOLD = (
    "h AS (SELECT partition_id, owner AS node_id FROM partition_map WHERE owner IS NOT NULL UNION "
    "SELECT partition_id, node_id FROM replicas)"
)


@query("partition_map replicas node_status", (
    f"WITH {HOLD} SELECT h.partition_id, count(*) AS required, string_agg(CASE WHEN s.durable IS NULL "
    f"OR s.applied IS NULL OR (h.partition_id + h.node_id) % 5 = 0 THEN CAST(h.node_id AS VARCHAR) END, ',' "
    f"ORDER BY h.node_id) AS waiting_for FROM h LEFT JOIN node_status s USING (partition_id, node_id) GROUP BY 1"
))
def split_readiness(t):
    """A split completes once its owner and all replicas have prepared; here a report that is not every fifth says so."""
    required = C.holders(t("partition_map"), t("replicas")).select("partition_id", "node_id").distinct()
    prepared = t("node_status").where((F.col("partition_id") + F.col("node_id")) % 5 != 0).groupBy("partition_id").agg(F.collect_set("node_id").alias("prepared"))
    sets = required.groupBy("partition_id").agg(F.collect_set("node_id").alias("required")).join(prepared, "partition_id", "left")
    waiting = F.array_sort(F.array_except("required", F.coalesce("prepared", F.array().cast("array<bigint>"))))
    return sets.select(
        "partition_id", F.size("required").cast("long").alias("required"),
        F.when(F.size(waiting) > 0, F.array_join(waiting, ",")).alias("waiting_for"),
    )


@query("partition_map replicas", """WITH h AS (SELECT p.partition_id, p.owner,
  string_agg(CAST(r.node_id AS VARCHAR), ',' ORDER BY r.node_id) AS reps FROM partition_map p LEFT JOIN replicas r USING (partition_id)
  GROUP BY 1, 2)
  SELECT a.keyspace_id, a.partition_id AS lower, b.partition_id AS upper, a.phase = 'serving' AND b.phase = 'serving'
    AND coalesce(x.owner = y.owner, FALSE) AND x.reps IS NOT DISTINCT FROM y.reps AS eligible, greatest(a.epoch, b.epoch) + 1 AS epoch
  FROM partition_map a JOIN partition_map b ON a.keyspace_id = b.keyspace_id AND a.end_key = b.start_key
    JOIN h x ON x.partition_id = a.partition_id JOIN h y ON y.partition_id = b.partition_id""")
def merge_eligible(t):
    """Adjacent, both serving, one owner, one replica set; the child's epoch is above both."""
    sets = t("replicas").groupBy("partition_id").agg(F.array_sort(F.collect_list("node_id")).alias("reps"))
    info = t("partition_map").select("partition_id", "owner", "epoch", "phase").join(sets, "partition_id", "left")
    side = lambda c: info.select(*[F.col(x).alias(f"{c}_{x}" if x != "partition_id" else c) for x in info.columns])
    pairs = R.adjacent(t("partition_map")).join(side("lower"), "lower").join(side("upper"), "upper")
    same = F.coalesce(F.col("lower_owner") == F.col("upper_owner"), F.lit(False)) & F.col("lower_reps").eqNullSafe(F.col("upper_reps"))
    return pairs.select(
        "keyspace_id", "lower", "upper",
        ((F.col("lower_phase") == "serving") & (F.col("upper_phase") == "serving") & same).alias("eligible"),
        (F.greatest("lower_epoch", "upper_epoch") + 1).alias("epoch"),
    )


ELIGIBLE = (
    "el AS (SELECT node_id FROM nodes WHERE role = 'worker' AND silent_millis < 1000 AND min_minor <= 2 "
    "AND max_minor >= 2 AND ready AND NOT draining)"
)
REQUIRED = (
    "rq AS (SELECT p.partition_id, coalesce(s.committed, s.durable, 0) AS required FROM partition_map p LEFT "
    "JOIN node_status s ON s.partition_id = p.partition_id AND s.node_id = p.owner)"
)


@query("partition_map replicas node_status nodes", f"""WITH {ELIGIBLE}, {REQUIRED}, {HOLD}, hs AS (SELECT partition_id,
  list(node_id ORDER BY node_id) AS holders FROM h GROUP BY 1),
  ok AS (SELECT r.partition_id, r.node_id FROM replicas r JOIN node_status s USING (partition_id, node_id) JOIN rq USING (partition_id)
    WHERE s.durable >= required AND r.node_id IN (SELECT node_id FROM el))
  SELECT a.partition_id AS lower, b.partition_id AS upper, CASE WHEN a.owner IS NULL OR b.owner IS NULL THEN 'unowned'
    WHEN a.owner = b.owner THEN 'together' WHEN x.holders <> y.holders THEN 'other holders'
    WHEN EXISTS (SELECT 1 FROM ok WHERE ok.partition_id = b.partition_id AND ok.node_id = a.owner) THEN 'move upper' WHEN EXISTS (SELECT 1
      FROM ok WHERE ok.partition_id = a.partition_id AND ok.node_id = b.owner) THEN 'move lower' ELSE 'refuse' END AS verdict
  FROM partition_map a JOIN partition_map b ON a.keyspace_id = b.keyspace_id AND a.end_key = b.start_key LEFT
    JOIN hs x ON x.partition_id = a.partition_id LEFT JOIN hs y ON y.partition_id = b.partition_id""")
def merge_colocation(t):
    """How two neighbours can come under one owner: whichever can move where it is already held, caught up."""
    owners = t("partition_map").select("partition_id", F.col("owner").alias("node_id"))
    ok = R.caught_up(
        t("replicas").select("partition_id", "node_id"), t("node_status"), C.eligible(t("nodes")), owners,
    ).select("partition_id", "node_id").withColumn("ok", F.lit(True))
    holders = C.holders(t("partition_map"), t("replicas")).groupBy("partition_id").agg(F.array_sort(F.collect_set("node_id")).alias("holders"))
    info = t("partition_map").select("partition_id", "owner").join(holders, "partition_id", "left")
    pairs = R.adjacent(t("partition_map")).select("lower", "upper")
    for side in ("lower", "upper"):
        pairs = pairs.join(
            info.select(
                F.col("partition_id").alias(side), F.col("owner").alias(f"{side}_owner"),
                F.col("holders").alias(f"{side}_holders"),
            ),
            side,
        )
    moves = lambda side, to: ok.select(
        F.col("partition_id").alias(side), F.col("node_id").alias(f"{to}_owner"),
        F.col("ok").alias(f"move_{side}"),
    )
    pairs = pairs.join(moves("upper", "lower"), ["upper", "lower_owner"], "left").join(moves("lower", "upper"), ["lower", "upper_owner"], "left")
    verdict = F.when(
        F.col("lower_owner").isNull() | F.col("upper_owner").isNull(), "unowned",
    ).when(F.col("lower_owner") == F.col("upper_owner"), "together").when(
        F.col("lower_holders") != F.col("upper_holders"), "other holders",
    ).when(F.col("move_upper"), "move upper").when(F.col("move_lower"), "move lower").otherwise("refuse")
    return pairs.select("lower", "upper", verdict.alias("verdict"))
