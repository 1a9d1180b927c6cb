"""Control-plane analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import control as C
from tidemark.operators import ranges as R
from tidemark.plans.ranging import ELIGIBLE, HOLD, REQUIRED
from tidemark.plans.registry import query

MAPS = "partition_map replicas node_status nodes"
VIEW = (
    "v AS (SELECT p.keyspace_id, p.partition_id, p.owner, o.committed, o.size_bytes, o.index_bytes "
    "FROM partition_map p LEFT JOIN node_status o ON o.partition_id = p.partition_id AND o.node_id = p.owner)"
)
HEALTH = "CASE WHEN silent_millis >= 3000 THEN 'dead' WHEN silent_millis >= 1000 THEN 'suspect' ELSE 'healthy' END"
LAG = (
    f"{VIEW}, lag AS (SELECT v.partition_id, v.keyspace_id, CASE "
    f"WHEN any_value(v.committed) IS NOT NULL THEN coalesce(max(greatest(v.committed - s.applied, 0)), 0) END AS applied_lag, "
    f"CASE "
    f"WHEN any_value(v.committed) IS NOT NULL THEN coalesce(max(greatest(v.committed - s.durable, 0)), 0) END AS wal_lag, "
    f"count(r.node_id) - count(s.durable) AS unknown FROM v LEFT JOIN replicas r USING (partition_id) LEFT "
    f"JOIN node_status s ON s.partition_id = r.partition_id AND s.node_id = r.node_id GROUP BY 1, 2)"
)


def view(t):
    own = t("node_status").select("partition_id", F.col("node_id").alias("owner"), "committed", "size_bytes", "index_bytes")
    return t("partition_map").select("keyspace_id", "partition_id", "owner").join(own, ["partition_id", "owner"], "left")


def lags(t):
    position = t("replicas").select("partition_id", "node_id").join(
        t("node_status").select("partition_id", "node_id", "applied", "durable"), ["partition_id", "node_id"],
        "left",
    )
    rows = view(t).join(position, "partition_id", "left")
    lag = lambda c: C.replica_lag(F.col("committed"), F.col(c))
    return rows.groupBy("partition_id", "keyspace_id").agg(
        lag("applied").alias("applied_lag"), lag("durable").alias("wal_lag"),
        (F.count("node_id") - F.count("durable")).alias("unknown"),
    )


@query(MAPS, (
    f"WITH {VIEW} SELECT keyspace_id, count(*) AS partitions, "
    f"CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS stored_bytes, count(*) - count(size_bytes) AS without_size "
    f"FROM v GROUP BY 1"
))
def keyspace_totals(t):
    return view(t).groupBy("keyspace_id").agg(
        F.count("*").alias("partitions"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("stored_bytes"),
        F.count_if(F.col("size_bytes").isNull()).alias("without_size"),
    )


@query(MAPS + " keyspaces", f"""WITH {VIEW}, k AS (SELECT keyspace_id, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS stored,
  count(*) - count(size_bytes) AS unknown FROM v GROUP BY 1)
  SELECT name, CASE WHEN max_storage_bytes IS NULL THEN 'unlimited' WHEN max_storage_bytes = 0 THEN 'closed'
    WHEN unknown = 0 THEN 'fraction' ELSE 'at_least' END AS use, CASE
    WHEN max_storage_bytes > 0 THEN stored / max_storage_bytes END AS fraction,
    coalesce(max_storage_bytes = 0 OR stored >= max_storage_bytes, FALSE) AS over FROM keyspaces JOIN k USING (keyspace_id)""")
def quota_use(t):
    """No limit is not a limit of 0; unknown sizes make a fraction a floor."""
    rows = keyspace_totals(t).join(F.broadcast(t("keyspaces").select("keyspace_id", "name", "max_storage_bytes")), "keyspace_id")
    limit = F.col("max_storage_bytes")
    use = F.when(limit.isNull(), "unlimited").when(limit == 0, "closed").when(F.col("without_size") == 0, "fraction").otherwise("at_least")
    return rows.select(
        "name", use.alias("use"), F.when(limit > 0, F.col("stored_bytes") / limit).alias("fraction"),
        F.coalesce((limit == 0) | (F.col("stored_bytes") >= limit), F.lit(False)).alias("over"),
    )


@query(MAPS, f"""WITH {LAG}, n AS (SELECT node_id, {HEALTH} AS health FROM nodes), i AS (SELECT n.node_id, CASE
  WHEN count(*) = count(s.index_bytes) THEN sum(s.index_bytes) END AS index_bytes, coalesce(sum(s.index_bytes), 0) AS known FROM n LEFT
  JOIN node_status s USING (node_id) GROUP BY 1)
  SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FILTER (health = 'healthy') FROM n) AS healthy,
    (SELECT count(*) FILTER (health = 'suspect') FROM n) AS suspect, (SELECT count(*) FILTER (health = 'dead') FROM n) AS dead,
    count(*) AS partitions,
    count(*) FILTER (NOT EXISTS (SELECT 1 FROM replicas r WHERE r.partition_id = p.partition_id)) AS without_replica,
      count(*) FILTER (NOT EXISTS (SELECT 1 FROM n WHERE n.node_id = p.owner AND health = 'healthy')) AS unhealthy_owner,
    coalesce(max(l.applied_lag), 0) AS max_replica_lag, coalesce(max(l.wal_lag), 0) AS max_wal_lag, count(*) FILTER (l.applied_lag IS NULL) AS without_progress, CAST(sum(l.unknown) AS BIGINT) AS without_position,
    (SELECT CASE WHEN count(*) = count(index_bytes) THEN CAST(sum(index_bytes) AS BIGINT) END FROM i) AS index_bytes,
      (SELECT CAST(coalesce(sum(index_bytes), 0) AS BIGINT) FROM i) AS known_index_bytes FROM partition_map p
      JOIN lag l USING (partition_id)""")
def cluster_summary(t):
    """The whole cluster on one row: what is unknown is counted, never taken for zero."""
    health = C.health(F.col("silent_millis"))
    nodes = t("nodes").select("node_id", health.alias("health"))
    index = nodes.select("node_id").join(
        t("node_status").select("node_id", "index_bytes"), "node_id", "left",
    ).groupBy("node_id").agg(F.when(F.count("*") == F.count("index_bytes"), F.sum("index_bytes")).alias("index_bytes"))
    index = index.agg(
        C.poisoned_sum(F.col("index_bytes")).alias("index_bytes"),
        F.coalesce(F.sum("index_bytes"), F.lit(0)).alias("known_index_bytes"),
    )
    counts = nodes.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("health") == h).alias(h) for h in ("healthy", "suspect", "dead")])
    with_replica = t("replicas").select("partition_id").distinct().withColumn("has", F.lit(True))
    rows = t("partition_map").select("partition_id", "owner").join(lags(t), "partition_id").join(with_replica, "partition_id", "left").join(
        nodes.select(F.col("node_id").alias("owner"), F.col("health").alias("owner_health")), "owner", "left",
    )
    parts = rows.agg(
        F.count("*").alias("partitions"), F.count_if(F.col("has").isNull()).alias("without_replica"), F.count_if(F.coalesce(F.col("owner_health") != "healthy", F.lit(True))).alias("unhealthy_owner"),
        F.coalesce(F.max("applied_lag"), F.lit(0)).alias("max_replica_lag"), F.coalesce(F.max("wal_lag"), F.lit(0)).alias("max_wal_lag"), F.count_if(F.col("applied_lag").isNull()).alias("without_progress"), F.sum("unknown").alias("without_position"),
    )
    return counts.crossJoin(parts).crossJoin(index)  # a row each


@query(MAPS, (
    "SELECT node_id, CASE "
    "WHEN count(*) = count(index_bytes) THEN CAST(sum(index_bytes) AS BIGINT) END AS index_bytes, "
    "CAST(coalesce(sum(index_bytes), 0) AS BIGINT) AS known_bytes, count(*) - count(index_bytes) AS unknown "
    "FROM node_status GROUP BY 1"
))
def index_memory(t):
    x = F.col("index_bytes")
    return t("node_status").groupBy("node_id").agg(
        C.poisoned_sum(x).alias("index_bytes"), F.coalesce(F.sum(x), F.lit(0)).alias("known_bytes"),
        (F.count("*") - F.count(x)).alias("unknown"),
    )


@query(MAPS, f"WITH {LAG} SELECT partition_id, applied_lag, wal_lag, unknown FROM lag")
def partition_lag(t):
    return lags(t).drop("keyspace_id")


@query("nodes", f"SELECT node_id, silent_millis, {HEALTH} AS health FROM nodes")
def node_health(t):
    return t("nodes").select("node_id", "silent_millis", C.health(F.col("silent_millis")).alias("health"))


@query(MAPS, (
    "SELECT p.partition_id, p.owner, p.epoch + 1 AS epoch FROM partition_map p JOIN nodes n ON n.node_id = p.owner "
    "WHERE n.silent_millis >= 3000"
))
def fence_plan(t):
    dead = t("nodes").where(C.health(F.col("silent_millis")) == "dead").select(F.col("node_id").alias("owner"))
    return t("partition_map").join(dead, "owner", "left_semi").select("partition_id", "owner", (F.col("epoch") + 1).alias("epoch"))


@query(MAPS, f"""WITH {ELIGIBLE}, r AS (SELECT p.partition_id, r.node_id, n.silent_millis >= 3000 AS dead, s.durable,
  coalesce(s.map_version >= p.fence_map_version, FALSE) AS reported, n.node_id IS NULL AS nobody FROM partition_map p LEFT
  JOIN replicas r USING (partition_id) LEFT JOIN nodes n ON n.node_id = r.node_id LEFT
  JOIN node_status s ON s.partition_id = r.partition_id AND s.node_id = r.node_id),
  q AS (SELECT partition_id, bool_and(node_id IS NULL OR (NOT nobody AND (dead OR reported))) AS settled,
    max(durable) FILTER (NOT dead) AS required FROM r GROUP BY 1)
  SELECT q.partition_id, min(r.node_id) FILTER (settled AND r.durable = q.required AND r.node_id IN (SELECT node_id FROM el)) AS candidate
    FROM q JOIN r USING (partition_id) GROUP BY 1""")
def promotion_plan(t):
    return C.promotions(t("partition_map"), t("replicas"), t("nodes"), t("node_status"))


@query("nodes", f"WITH {ELIGIBLE} SELECT node_id FROM el")
def eligible_owners(t):
    return C.eligible(t("nodes")).select("node_id")


RANK = (
    f"{ELIGIBLE}, hc AS (SELECT node_id, count(*) AS held, count(*) FILTER (owned) AS owned "
    f"FROM (SELECT owner AS node_id, TRUE AS owned FROM partition_map WHERE owner IS NOT NULL UNION ALL "
    f"SELECT node_id, FALSE FROM replicas) GROUP BY 1), rk AS (SELECT node_id, coalesce(held, 0) AS held, "
    f"coalesce(owned, 0) AS owned, row_number() OVER (ORDER BY coalesce(held, 0), node_id) AS rank FROM el LEFT "
    f"JOIN hc USING (node_id))"
)


@query(MAPS, f"WITH {RANK} SELECT * FROM rk")
def placement_rank(t):
    return C.placement(t("nodes"), t("partition_map"), t("replicas"))


@query(MAPS, f"""WITH {RANK}, kp AS (SELECT p.partition_id, p.owner,
  coalesce(list(r.node_id ORDER BY r.position) FILTER (r.node_id IS NOT NULL), []) AS before,
  coalesce(list(r.node_id ORDER BY r.position) FILTER (n.silent_millis < 3000), []) AS kept FROM partition_map p LEFT
  JOIN replicas r USING (partition_id) LEFT JOIN nodes n ON n.node_id = r.node_id WHERE p.phase = 'serving' AND p.owner IS NOT NULL
  GROUP BY 1, 2),
  al AS (SELECT partition_id, before, list_concat(kept, list_slice(list_filter((SELECT list(node_id ORDER BY rank) FROM rk),
    lambda x: x <> owner AND NOT list_contains(kept, x)), 1, greatest(2 - len(kept), 0))) AS after FROM kp)
  SELECT partition_id, array_to_string(before, ',') AS before, array_to_string(after, ',') AS after FROM al WHERE before <> after""")
def repair_plan(t):
    want = 2  # floor: one less than the replication factor; a read target would raise it
    plan = C.repair(t("partition_map"), t("replicas"), t("nodes"), want)
    return plan.select("partition_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query(MAPS, f"""WITH {RANK}, {REQUIRED}, ow AS (SELECT el.node_id, count(p.partition_id) AS owned FROM el LEFT
  JOIN partition_map p ON p.owner = el.node_id GROUP BY 1), b AS (SELECT node_id, owned FROM ow ORDER BY owned DESC, node_id DESC LIMIT 1),
  m AS (SELECT p.partition_id, b.node_id AS from_node, r.node_id AS to_node, ow.owned FROM b JOIN partition_map p ON p.owner = b.node_id
    AND p.phase = 'serving' JOIN replicas r USING (partition_id) JOIN ow ON ow.node_id = r.node_id
    JOIN node_status s ON s.partition_id = r.partition_id AND s.node_id = r.node_id JOIN rq ON rq.partition_id = p.partition_id
    WHERE s.durable >= rq.required AND b.owned - ow.owned >= 2 AND r.node_id <> b.node_id)
  SELECT partition_id, from_node, to_node FROM m ORDER BY owned, to_node, partition_id LIMIT 1""")
def rebalance_plan(t):
    """At most one move: from the busiest eligible node to the emptiest that may take one of its partitions, if they are two apart."""
    ranked = C.placement(t("nodes"), t("partition_map"), t("replicas")).select("node_id", "owned")
    busiest = ranked.orderBy(F.desc("owned"), F.desc("node_id")).limit(1).select(
        F.col("node_id").alias("from_node"), F.col("owned").alias("most"),
    )
    mine = t("partition_map").where("phase = 'serving'").join(F.broadcast(busiest), F.col("owner") == F.col("from_node")).select("partition_id", "from_node", "most")
    owners = t("partition_map").select("partition_id", F.col("owner").alias("node_id"))
    ready = R.caught_up(
        t("replicas").select("partition_id", "node_id"), t("node_status"), C.eligible(t("nodes")), owners,
    ).select("partition_id", "node_id")
    moves = ready.join(mine, "partition_id").join(ranked, "node_id").where((F.col("most") - F.col("owned") >= C.SKEW) & (F.col("node_id") != F.col("from_node")))
    return moves.orderBy("owned", "node_id", "partition_id").limit(1).select("partition_id", "from_node", F.col("node_id").alias("to_node"))


@query(MAPS, f"""WITH {ELIGIBLE}, {REQUIRED}, ok AS (SELECT r.partition_id, r.node_id, r.position FROM replicas r
  JOIN node_status s USING (partition_id, node_id) JOIN rq USING (partition_id) WHERE s.durable >= required
  AND r.node_id IN (SELECT node_id FROM el)),
  pl AS (SELECT p.owner, p.partition_id, arg_min(ok.node_id, ok.position) AS target FROM partition_map p LEFT JOIN ok USING (partition_id)
    WHERE p.owner IS NOT NULL GROUP BY 1, 2)
  SELECT owner, partition_id, target, bool_and(target IS NOT NULL) OVER (PARTITION BY owner) AS drains FROM pl""")
def drain_plan(t):
    """The first caught-up replica of every partition of a node; a node drains only if each has one."""
    owners = t("partition_map").select("partition_id", F.col("owner").alias("node_id"))
    ready = R.caught_up(t("replicas"), t("node_status"), C.eligible(t("nodes")), owners)
    target = ready.groupBy("partition_id").agg(F.min_by("node_id", "position").alias("target"))
    plan = t("partition_map").where("owner IS NOT NULL").select("owner", "partition_id").join(target, "partition_id", "left")
    return plan.select(
        "owner", "partition_id", "target",
        F.every(F.col("target").isNotNull()).over(Window.partitionBy("owner")).alias("drains"),
    )


@query("nodes", """WITH l AS (SELECT * FROM nodes WHERE silent_millis < 3000), m AS (SELECT min((max_major, max_minor)) AS target FROM l)
  SELECT active.a AS active_minor, CAST(target[2] AS BIGINT) AS target_minor, CASE WHEN target <= (0, active.a) THEN 'no newer version'
    WHEN (SELECT bool_and((min_major, min_minor) <= target) FROM l) THEN 'advance' ELSE 'skipped' END AS verdict FROM m CROSS
    JOIN (VALUES (1), (2), (3)) AS active(a)""".replace(
      "target[2]", "(SELECT min(max_minor) FROM l WHERE max_major = (SELECT min(max_major) FROM l))",
  ))
def upgrade_target(t):
    """The newest version that all living nodes can reach, if it is above the active one and in everybody's window."""
    live = t("nodes").where(C.health(F.col("silent_millis")) != "dead")
    target = live.agg(F.min(C.version("max_major", "max_minor")).alias("target"))
    fits = live.crossJoin(F.broadcast(target)).agg(
        F.every(C.version("min_major", "min_minor") <= F.col("target")).alias("fits"),
        F.min("target").alias("target"),
    )
    rows = fits.select("fits", "target", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("active_minor"))
    active = F.struct(F.lit(0).cast("long").alias("major"), F.col("active_minor").cast("long").alias("minor"))
    return rows.select(
        "active_minor", F.col("target.minor").alias("target_minor"),
        F.when(F.col("target") <= active, "no newer version").when(F.col("fits"), "advance").otherwise("skipped").alias("verdict"),
    )


@query("nodes", """WITH c AS (SELECT DISTINCT ON (node_id) node_id, node_identity, zone FROM nodes ORDER BY node_id, node_identity),
  f AS (SELECT *, zone <> '' AND row_number() OVER (PARTITION BY zone ORDER BY node_identity, node_id) = 1 AS first FROM c)
  SELECT node_id, node_identity, zone, row_number() OVER (ORDER BY NOT first, node_identity, node_id) AS place FROM f""")
def select_voters(t):
    """By identity, one of each known failure domain first, then the rest. Voters are few, so one ranking does."""
    first = (F.col("zone") != "") & (F.row_number().over(Window.partitionBy("zone").orderBy("node_identity", "node_id")) == 1)
    rows = t("nodes").select("node_id", "node_identity", "zone").withColumn("first", first)
    return rows.withColumn(
        "place",
        F.row_number().over(Window.orderBy(~F.col("first"), "node_identity", "node_id")).cast("long"),
    ).drop("first")


@query("", """WITH c AS (SELECT o_orderkey AS place, o_custkey % 25 AS partition_id, CASE o_orderkey % 4 WHEN 0 THEN 'assign'
  WHEN 1 THEN 'fence' WHEN 2 THEN 'serve' ELSE 'forget' END AS kind, 1 + o_custkey % 10 AS node FROM orders)
  SELECT partition_id, arg_max(kind, place) AS phase, 1 + count(*) FILTER (kind IN ('assign', 'fence')) AS epoch, CASE WHEN arg_max(kind,
    place) FILTER (kind <> 'serve') = 'assign' THEN arg_max(node, place) FILTER (kind <> 'serve') END AS owner, count(*) AS commands FROM c
    GROUP BY 1""")
def map_after_log(t):
    """A partition's owner, phase and epoch after a log of commands (here from orders): the last ones decide, all are counted."""
    kind = F.element_at(F.array(*map(F.lit, ("assign", "fence", "serve", "forget"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    log = t("orders").select(
        F.col("o_orderkey").alias("at"), (F.col("o_custkey") % 25).alias("partition_id"), kind.alias("kind"),
        (1 + F.col("o_custkey") % 10).alias("node"),
    )
    moves = F.when(F.col("kind") != "serve", F.col("at"))
    last = log.groupBy("partition_id").agg(
        F.max_by("kind", "at").alias("phase"),
        (1 + F.count_if(F.col("kind").isin("assign", "fence"))).alias("epoch"),
        F.max_by(F.struct("kind", "node"), moves).alias("m"), F.count("*").alias("commands"),
    )
    return last.select("partition_id", "phase", "epoch", F.when(F.col("m.kind") == "assign", F.col("m.node")).alias("owner"), "commands")


SERVING = (
    f"{HOLD}, sv AS (SELECT p.keyspace_id, greatest(count(DISTINCT p.owner), 1) AS writers, "
    f"greatest(count(DISTINCT h.node_id), 1) AS readers FROM partition_map p LEFT JOIN h USING (partition_id) "
    f"GROUP BY 1)"
)


def serving(t):
    held = C.holders(t("partition_map"), t("replicas")).select("partition_id", "node_id")
    rows = t("partition_map").select("keyspace_id", "partition_id", "owner").join(held, "partition_id", "left")
    return rows.groupBy("keyspace_id").agg(
        F.greatest(F.count_distinct("owner"), F.lit(1)).alias("writers"),
        F.greatest(F.count_distinct("node_id"), F.lit(1)).alias("readers"),
    )


@query(MAPS, f"WITH {SERVING} SELECT * FROM sv")
def serving_counts(t):
    return serving(t)


CONDITIONS = ("identity", "compatible", "joined", "recovered", "caught_up", "replicas", "accepting", "policy")


@query("nodes", """WITH u AS (SELECT node_id, list_filter([CASE WHEN node_id % 17 = 0 THEN 'identity' END, CASE
  WHEN max_minor < 3 THEN 'compatible' END, CASE WHEN silent_millis >= 3000 THEN 'joined' END, CASE
  WHEN node_id % 13 = 0 THEN 'recovered' END, CASE WHEN node_id % 8 = 0 THEN 'caught_up' END, CASE
  WHEN node_id % 10 = 0 THEN 'replicas' END, CASE WHEN draining THEN 'accepting' END, CASE WHEN node_id % 19 = 0 THEN 'policy' END],
  lambda x: x IS NOT NULL) AS unmet FROM nodes)
  SELECT node_id, len(unmet) = 0 AS ready, array_to_string(unmet, ',') AS unmet FROM u""")
def readiness_unmet(t):
    """The conditions a node does not meet, in reporting order; ready is none."""
    by = lambda n: F.col("node_id") % n == 0
    fails = (by(17), F.col("max_minor") < 3, C.health(F.col("silent_millis")) == "dead", by(13), by(8), by(10), F.col("draining"), by(19))
    unmet = F.array_compact(F.array(*[F.when(f, c) for c, f in zip(CONDITIONS, fails)]))
    return t("nodes").select("node_id", (F.size(unmet) == 0).alias("ready"), F.array_join(unmet, ",").alias("unmet"))


BOUNDS = (5.0, 25.0, 100.0, 250.0)


@query("", (
    "SELECT user_id % 5 AS keyspace_id, event_type AS operation, CAST(CASE WHEN value < 5 THEN 0 "
    "WHEN value < 25 THEN 1 WHEN value < 100 THEN 2 WHEN value < 250 THEN 3 ELSE 4 END AS INTEGER) AS bucket, "
    "count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3"
))
def latency_histogram(t):
    """Requests by latency bucket; forwarded ones (errors here) are their owner's to count."""
    bucket = sum((F.when(F.col("value") >= b, 1).otherwise(0) for b in BOUNDS[1:]), F.when(F.col("value") >= BOUNDS[0], 1).otherwise(0))
    return t("events").where("event_type <> 'error'").groupBy(
        (F.col("user_id") % 5).alias("keyspace_id"), F.col("event_type").alias("operation"),
        bucket.alias("bucket"),
    ).agg(F.count("*").alias("n"))


@query("lifecycle", "SELECT kind, outcome, count(*) AS n FROM lifecycle GROUP BY 1, 2")
def lifecycle_counts(t):
    return t("lifecycle").groupBy("kind", "outcome").agg(F.count("*").alias("n"))
