"""The replication log: recovery, retention, quorum, lag, leases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.operators.folds import fold
from tidemark.plans.registry import query


def by_partition(*order: str):
    window = Window.partitionBy("partition_id")
    return window.orderBy(*order) if order else window


@query("wal", """WITH b AS (SELECT partition_id, min(position) FILTER (frame <> 'ok') AS bad, arg_min(frame,
  position) FILTER (frame <> 'ok') AS reason FROM wal GROUP BY 1)
  SELECT w.partition_id, count(*) FILTER (bad IS NULL OR position < bad) AS accepted, count(*) FILTER (position >= bad) AS removed,
    any_value(reason) AS reason, count(*) FILTER ((bad IS NULL OR position < bad) AND lamport > 500) AS replay FROM wal w
    JOIN b USING (partition_id) GROUP BY 1""")
def wal_recover(t):
    """Frames count up to the first bad one of a partition; it and all after it go. Entries above the checkpoint (500) are replayed."""
    wal = t("wal")
    bad = F.col("frame") != "ok"
    first = wal.groupBy("partition_id").agg(
        F.min(F.when(bad, F.col("position"))).alias("bad"),
        F.min_by("frame", F.when(bad, F.col("position"))).alias("reason"),
    )
    first = first.withColumn("reason", F.when(F.col("bad").isNotNull(), F.col("reason")))
    good = F.col("bad").isNull() | (F.col("position") < F.col("bad"))
    return wal.join(F.broadcast(first), "partition_id").groupBy("partition_id").agg(
        F.count_if(good).alias("accepted"), F.count_if(~good).alias("removed"),
        F.any_value("reason").alias("reason"), F.count_if(good & (F.col("lamport") > 500)).alias("replay"),
    )


@query("wal", "SELECT partition_id, count(*) AS kept, max(lamport) AS durable FROM wal WHERE lamport <= 700 + partition_id GROUP BY 1")
def wal_truncate(t):
    return t("wal").where(F.col("lamport") <= 700 + F.col("partition_id")).groupBy("partition_id").agg(
        F.count("*").alias("kept"), F.max("lamport").alias("durable"),
    )


CATCH = """WITH r AS (SELECT partition_id, lamport FROM wal WHERE lamport > 400 OR partition_id <> 1), d AS (SELECT partition_id,
  max(lamport) AS durable FROM wal GROUP BY 1), a AS (SELECT d.partition_id, n.n AS asked, d.durable, CASE n.n WHEN 1 THEN 100
  WHEN 2 THEN 400 ELSE d.durable END AS after FROM d CROSS JOIN (VALUES (1), (2), (3)) AS n(n))
  SELECT a.partition_id, a.after, CASE WHEN min(r.lamport) = a.after + 1 THEN 'entries' WHEN min(r.lamport) IS NOT NULL
    OR a.after < a.durable THEN 'beyond_retention' ELSE 'up_to_date' END AS class, CASE
    WHEN min(r.lamport) > a.after + 1 THEN min(r.lamport) END AS retained_from, count(r.lamport) AS entries FROM a LEFT
    JOIN r ON r.partition_id = a.partition_id AND r.lamport > a.after GROUP BY a.partition_id, a.after, a.durable"""


@query("wal", CATCH)
def catch_up_class(t):
    """What a replica at a position can be sent: entries, nothing, or nothing any more. Partition 1 keeps only what is above 400."""
    wal = t("wal")
    asked = wal.groupBy("partition_id").agg(F.max("lamport").alias("durable")).select(
        "partition_id", "durable",
        F.explode(F.array(F.lit(100).cast("long"), F.lit(400).cast("long"), F.col("durable"))).alias("after"),
    )
    kept = wal.where("lamport > 400 OR partition_id <> 1").select("partition_id", "lamport")
    rows = kept.join(F.broadcast(asked), "partition_id").where("lamport > after").groupBy("partition_id", "after").agg(
        F.min("lamport").alias("first"), F.count("*").alias("entries"),
    )
    rows = asked.join(rows, ["partition_id", "after"], "left")
    kind = F.when(F.col("first") == F.col("after") + 1, "entries").when(
        F.col("first").isNotNull() | (F.col("after") < F.col("durable")), "beyond_retention",
    ).otherwise("up_to_date")
    return rows.select(
        "partition_id", "after", kind.alias("class"),
        F.when(F.col("first") > F.col("after") + 1, F.col("first")).alias("retained_from"),
        F.coalesce("entries", F.lit(0)).alias("entries"),
    )


@query("wal", """WITH f AS (SELECT partition_id, file, max(lamport) AS top, max(file) OVER (PARTITION BY partition_id) AS current FROM wal
  GROUP BY 1, 2)
  SELECT partition_id, file, top FROM (SELECT *, bool_and(top <= 750
    AND file <> current) OVER (PARTITION BY partition_id ORDER BY file) AS gone FROM f) WHERE gone""")
def wal_retention(t):
    """Leading files that hold nothing above the checkpoint (750) may go, never the current one."""
    files = t("wal").groupBy("partition_id", "file").agg(F.max("lamport").alias("top")).withColumn("current", F.max("file").over(by_partition()))
    gone = F.every((F.col("top") <= 750) & (F.col("file") != F.col("current"))).over(by_partition("file"))
    return files.withColumn("gone", gone).where("gone").select("partition_id", "file", "top")


@query("wal", (
    "SELECT partition_id, min(lamport) AS from_lamport, max(lamport) AS to_lamport, count(*) AS entries "
    "FROM (SELECT partition_id, lamport, lamport - row_number() OVER (PARTITION BY partition_id "
    "ORDER BY lamport) AS island FROM wal WHERE lamport % 97 <> 0) GROUP BY partition_id, island"
))
def lamport_gaps(t):
    """Contiguous stretches of a log with holes: gaps lie between them."""
    rows = t("wal").where("lamport % 97 <> 0").select("partition_id", "lamport")
    rows = O.before(rows, ["partition_id"], ["lamport"], {"place": (O.COUNT, None)}).withColumn("island", F.col("lamport") - F.col("place"))
    return rows.groupBy("partition_id", "island").agg(
        F.min("lamport").alias("from_lamport"), F.max("lamport").alias("to_lamport"),
        F.count("*").alias("entries"),
    ).drop("island")


@query("wal", (
    "SELECT partition_id, lamport, e AS epoch, top FROM (SELECT *, max(e) OVER (PARTITION BY partition_id "
    "ORDER BY position) AS top FROM (SELECT *, CASE WHEN position % 150 = 149 THEN epoch - 1 ELSE epoch END AS e "
    "FROM wal)) WHERE e < top"
))
def stale_epoch_entries(t):
    """Entries of an owner that was deposed before they arrived."""
    sent = F.when(F.col("position") % 150 == 149, F.col("epoch") - 1).otherwise(F.col("epoch"))
    rows = t("wal").select("partition_id", "lamport", "position", sent.alias("epoch"))
    rows = O.before(rows, ["partition_id"], ["position"], {"top": (O.MAX, "epoch")})
    return rows.where("epoch < top").select("partition_id", "lamport", "epoch", "top")


QUORUM = (
    "WITH d AS (SELECT partition_id, max(lamport) AS durable FROM wal GROUP BY 1), k AS (SELECT partition_id, "
    "list(acked ORDER BY acked DESC) AS acked FROM acks GROUP BY 1), q AS (SELECT partition_id, durable, "
    "least(durable, CASE WHEN least(2, len(acked)) = 0 THEN durable ELSE acked[least(2, "
    "len(acked))] END) AS committed FROM d JOIN k USING (partition_id))"
)


def committed(t):
    """Per partition the prefix that enough replicas have acknowledged: the k-th largest ack, at most what is durable here."""
    own = t("wal").groupBy("partition_id").agg(F.max("lamport").alias("durable"))
    acks = t("acks").groupBy("partition_id").agg(F.sort_array(F.collect_list("acked"), False).alias("acked"))  # as long as a replica set
    need = F.least(F.lit(2), F.size("acked"))
    prefix = F.when(need == 0, F.col("durable")).otherwise(F.get("acked", need - 1))
    return own.join(acks, "partition_id").select("partition_id", "durable", F.least("durable", prefix).alias("committed"))


@query("wal acks", QUORUM + (
    " SELECT w.partition_id, q.committed, q.durable, count(*) FILTER (lamport > q.committed) AS indeterminate "
    "FROM wal w JOIN q USING (partition_id) GROUP BY 1, 2, 3"
))
def quorum_committed(t):
    """Durable here but short of a quorum: outcome unknown, not to be retried blindly."""
    return t("wal").join(F.broadcast(committed(t)), "partition_id").groupBy("partition_id", "committed", "durable").agg(F.count_if(F.col("lamport") > F.col("committed")).alias("indeterminate"))


@query("wal acks", QUORUM + (
    " SELECT partition_id, count(*) FILTER (through < committed AND committed > 0) AS replicas_behind, "
    "coalesce(max(committed - through) FILTER (through < committed AND committed > 0), 0) AS max_lamports "
    "FROM (SELECT q.partition_id, q.committed, CASE status WHEN 'stranded' THEN NULL WHEN 'unestablished' THEN 0 "
    "ELSE acked END AS through FROM acks JOIN q USING (partition_id)) GROUP BY 1"
))
def replication_lag(t):
    """Stranded replicas are reported elsewhere, unestablished ones are behind from the start; nothing committed, no lag."""
    through = F.when(F.col("status") == "unestablished", F.lit(0)).when(F.col("status") == "following", F.col("acked"))
    rows = t("acks").join(committed(t), "partition_id").withColumn("through", through)
    behind = F.coalesce((F.col("through") < F.col("committed")) & (F.col("committed") > 0), F.lit(False))
    return rows.groupBy("partition_id").agg(
        F.count_if(behind).alias("replicas_behind"),
        F.coalesce(F.max(F.when(behind, F.col("committed") - F.col("through"))), F.lit(0)).alias("max_lamports"),
    )


NOTES = (
    "n AS (SELECT partition_id, 1 + position % 3 AS node_id, position, lamport - (position * 7) % 40 AS reported, "
    "greatest(1, lamport - 120) - CASE WHEN position % 211 = 0 THEN -200 ELSE 0 END AS retained_from FROM wal)"
)


@query("wal", f"""WITH {NOTES}, s AS (SELECT *, reported + 1 >= retained_from AS follows FROM n), g AS (SELECT *,
  count(*) FILTER (NOT follows) OVER w AS spell FROM s WINDOW w AS (PARTITION BY partition_id, node_id ORDER BY position)),
  r AS (SELECT *, max(reported) FILTER (follows) OVER (PARTITION BY partition_id, node_id, spell ORDER BY position) AS through,
    row_number() OVER (PARTITION BY partition_id, node_id ORDER BY position DESC) AS last FROM g)
  SELECT partition_id, node_id, CASE WHEN follows THEN 'following' ELSE 'stranded' END AS status, CASE
    WHEN follows THEN through END AS through FROM r WHERE last = 1""")
def replica_status(t):
    """A follower's position only rises; being stranded ends it, and following again starts anew."""
    notes = t("wal").select(
        "partition_id", (1 + F.col("position") % 3).alias("node_id"), "position",
        (F.col("lamport") - (F.col("position") * 7) % 40).alias("reported"),
        (F.greatest(F.lit(1), F.col("lamport") - 120) + F.when(F.col("position") % 211 == 0, 200).otherwise(0)).alias("retained_from"),
    )
    notes = notes.withColumn("follows", F.col("reported") + 1 >= F.col("retained_from"))
    # The latest note decides; a spell of following is what came after the last stranded note.
    by = ["partition_id", "node_id"]
    ends = notes.groupBy(*by).agg(
        F.max(F.when(~F.col("follows"), F.col("position"))).alias("cut"),
        F.max_by("follows", "position").alias("follows"),
    )
    through = notes.where("follows").join(F.broadcast(ends.select(*by, "cut")), by).where(F.col("cut").isNull() | (F.col("position") > F.col("cut"))).groupBy(*by).agg(F.max("reported").alias("through"))
    return ends.join(through, by, "left").select(
        *by, F.when(F.col("follows"), "following").otherwise("stranded").alias("status"),
        F.when(F.col("follows"), F.col("through")).alias("through"),
    )


@query("wal", (
    "SELECT partition_id, count(*) AS entries, count(DISTINCT flush) AS flushes, "
    "count(*) / count(DISTINCT flush) AS per_flush FROM wal GROUP BY 1"
))
def entries_per_flush(t):
    flushes = t("wal").groupBy("partition_id", "flush").agg(F.count("*").alias("n")).groupBy("partition_id").agg(F.sum("n").alias("entries"), F.count("*").alias("flushes"))
    return flushes.withColumn("per_flush", F.try_divide("entries", "flushes"))


@query("wal acks", (
    "WITH d AS (SELECT partition_id, max(lamport) AS lamport FROM wal GROUP BY 1) SELECT a.partition_id, "
    "a.node_id, d.lamport - a.acked AS missing FROM acks a JOIN d USING (partition_id) WHERE a.acked < d.lamport "
    "AND (a.node_id * 170 + a.partition_id * 90) % 600 > 100"
))
def coherence_waiters(t):
    """Lease holders a write still waits for: they have not acknowledged it and their lease runs on (at time 100)."""
    top = t("wal").groupBy("partition_id").agg(F.max("lamport").alias("lamport"))
    until = (F.col("node_id") * 170 + F.col("partition_id") * 90) % 600
    return t("acks").join(top, "partition_id").where((F.col("acked") < F.col("lamport")) & (until > 100)).select(
        "partition_id", "node_id", (F.col("lamport") - F.col("acked")).alias("missing"),
    )


LEASE = """WITH RECURSIVE e AS (SELECT partition_id, position, lamport, CASE WHEN position % 10 = 0 THEN 'grant'
  WHEN position % 10 IN (3, 6) THEN 'applied' WHEN position % 10 = 8 THEN 'read' ELSE 'invalidate' END AS kind, CASE
  WHEN position % 170 = 61 THEN 1 ELSE 0 END AS lost FROM wal),
  f AS (SELECT partition_id, position, kind, lost, row_number() OVER (PARTITION BY partition_id ORDER BY position) AS n,
    count(*) FILTER (kind = 'invalidate') OVER (PARTITION BY partition_id ORDER BY position) AS seq FROM e),
  g AS (SELECT partition_id, CAST(0 AS BIGINT) AS n, '' AS kind, CAST(0 AS BIGINT) AS position, CAST(1 AS BIGINT) AS expects, FALSE AS gap,
    CAST(-1 AS BIGINT) AS until, CAST(0 AS BIGINT) AS applied FROM f WHERE n = 1
    UNION ALL SELECT f.partition_id, f.n, f.kind, f.position, CASE WHEN f.kind = 'invalidate' AND f.lost = 0
      AND f.seq >= g.expects THEN f.seq + 1 ELSE g.expects END,
      CASE WHEN f.kind = 'invalidate' AND f.lost = 0 AND f.seq > g.expects THEN TRUE WHEN f.kind = 'grant' AND g.expects > f.seq THEN FALSE
        ELSE g.gap END,
      CASE WHEN f.kind = 'invalidate' AND f.lost = 0 AND f.seq > g.expects THEN -1 WHEN f.kind = 'grant' THEN CASE
        WHEN g.expects > f.seq THEN f.position + 25 ELSE -1 END ELSE g.until END, CASE WHEN f.kind = 'applied' THEN g.expects - 1
        ELSE g.applied END
    FROM g JOIN f ON f.partition_id = g.partition_id AND f.n = g.n + 1)
  SELECT partition_id, position, position < until AND NOT gap AND expects - 1 = applied AS may_serve FROM g WHERE kind = 'read'"""


@query("wal", LEASE)
def replica_may_serve(t):
    """Whether a replica may answer each read: its lease runs, no invalidation was missed, none is unapplied.

    Events are folded in order for each partition: an invalidation expected next moves on,
    one beyond it (one in 170 is lost) opens a gap and drops the lease; a grant is taken
    only by a replica that knows of every write before it, and closes the gap.
    """
    kind = F.when(F.col("position") % 10 == 0, "grant").when((F.col("position") % 10).isin(3, 6), "applied").when(F.col("position") % 10 == 8, "read").otherwise("invalidate")
    events = t("wal").select(
        "partition_id", "position", kind.alias("kind"), (F.col("position") % 170 == 61).alias("lost"),
    ).withColumn("seq", F.count_if(F.col("kind") == "invalidate").over(by_partition("position")))

    def step(held, position, kind, lost, seq):
        expects, gap, until, applied = held
        serves = position < until and not gap and expects - 1 == applied
        if kind == "invalidate" and not lost:
            if seq > expects:
                gap, until = True, -1
            expects = max(expects, seq + 1) if seq >= expects else expects
        elif kind == "grant":
            takes = expects > seq
            gap, until = (False, position + 25) if takes else (gap, -1)
        elif kind == "applied":
            applied = expects - 1
        return (expects, gap, until, applied), (serves,)

    folded = fold(
        events, ["partition_id"], ["position"], ["position", "kind", "lost", "seq"], "may_serve boolean",
        lambda: (1, False, -1, 0), step,
    )
    return folded.where("kind = 'read'").select("partition_id", "position", "may_serve")


@query("wal acks", QUORUM + " SELECT w.partition_id, w.lamport, w.key FROM wal w JOIN q USING (partition_id) WHERE w.lamport > q.committed")
def surrendered_writes(t):
    """What a quiesced owner gives up: its log above the committed prefix."""
    return t("wal").join(F.broadcast(committed(t)), "partition_id").where("lamport > committed").select("partition_id", "lamport", "key")
