"""Sorted runs: statistics, merges, snapshots, sweeps and the segment format."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.crc32c import crc32c_column
from tidemark.functions.keys import in_range
from tidemark.operators import lsm as L
from tidemark.operators import state as S
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources.segment import read_objects, write_segments

MID = "(SELECT (min(now_millis) + max(now_millis)) // 2 FROM mutation_log)"
WON = """won AS (SELECT keyspace_id, key, max(lamport) AS lamport, max_by(sequence, lamport) AS sequence, max_by(deleted,
  lamport) AS deleted, max_by(value_bytes, lamport) AS value_bytes, arg_max_null(expires_at_millis, lamport) AS expires_at_millis
  FROM {src} GROUP BY 1, 2)"""
COVERED = (
    "EXISTS (SELECT 1 FROM segments s WHERE s.keyspace_id = won.keyspace_id AND s.sequence < 5 "
    "AND s.min_key <= won.key AND won.key <= s.max_key AND s.min_lamport < won.lamport)"
)
EXPIRED = f"coalesce(expires_at_millis <= {MID}, FALSE)"
INPUTS = "WITH " + WON.format(src="segment_records WHERE sequence >= 5") + " SELECT keyspace_id, key, lamport, deleted FROM won WHERE "
ALL = "WITH " + WON.format(src="segment_records")
USES = "mutation_log segment_records segments"


def _mid(t):
    """The middle of the log's times, as a one-row side of the plan."""
    return t("mutation_log").agg(F.expr("(min(now_millis) + max(now_millis)) div 2")).scalar()


@query("mutations", """WITH h AS (SELECT keyspace_id, max(lamport) - 300 AS horizon FROM mutations GROUP BY 1), n AS (SELECT keyspace_id,
  key, max(lamport) AS version FROM mutations GROUP BY 1, 2)
  SELECT keyspace_id, count(*) FILTER (version <= horizon) AS flushed, count(*) FILTER (version > horizon) AS kept,
    min(key) FILTER (version <= horizon) AS min_key, max(key) FILTER (version <= horizon) AS max_key FROM n JOIN h USING (keyspace_id)
    GROUP BY 1""")
def flush_segments(t):
    """A flush empties the memtable of what is committed; newer versions stay in it."""
    log = t("mutations")
    horizon = log.groupBy("keyspace_id").agg((F.max("lamport") - 300).alias("horizon"))
    own = S.replay(log).join(F.broadcast(horizon), "keyspace_id")
    done = F.col("version") <= F.col("horizon")
    return own.groupBy("keyspace_id").agg(
        F.count_if(done).alias("flushed"), F.count_if(~done).alias("kept"),
        F.min(F.when(done, F.col("key"))).alias("min_key"),
        F.max(F.when(done, F.col("key"))).alias("max_key"),
    )


@query(USES, "SELECT keyspace_id, sequence, bytes, record_count, min_key, max_key, min_lamport, max_lamport FROM segments")
def segment_stats(t):
    return L.segment_stats(t("segment_records"), ["keyspace_id", "sequence"])


@query(USES, INPUTS + f"NOT {EXPIRED} AND (NOT deleted OR {COVERED})")
def compact_partial(t):
    return L.merge_partial(
        t("segment_records").where("sequence >= 5"), t("segments").where("sequence < 5"), _mid(t),
    ).select(*S.KEY, "lamport", "deleted")


@query(USES, INPUTS + f"NOT {EXPIRED} OR {COVERED}")
def compact_bounded(t):
    return L.merge_bounded(
        t("segment_records").where("sequence >= 5"), t("segments").where("sequence < 5"), _mid(t),
    ).select(*S.KEY, "lamport", "deleted")


@query(USES, ALL + f" SELECT keyspace_id, key, lamport, deleted FROM won WHERE NOT {EXPIRED}")
def compact_full(t):
    return L.merge_full(t("segment_records"), _mid(t)).select(*S.KEY, "lamport", "deleted")


@query(USES, (
    "SELECT keyspace_id, key, lamport, count(*) AS copies FROM (SELECT keyspace_id, key, lamport "
    "FROM segment_records UNION ALL SELECT keyspace_id, key, lamport FROM segment_records WHERE lamport % 50 = 1) "
    "GROUP BY 1, 2, 3 HAVING count(*) > 1"
))
def duplicate_lamports(t):
    rows = t("segment_records")
    return L.duplicate_lamports(rows.union(rows.where("lamport % 50 = 1")))


@query(USES, ALL + """, c AS (SELECT s.keyspace_id, s.sequence, coalesce(w.winners, 0) AS winners, s.record_count, s.bytes FROM segments s
  LEFT JOIN (SELECT keyspace_id, sequence, count(*) AS winners FROM won GROUP BY 1, 2) w USING (keyspace_id, sequence)
  WHERE coalesce(w.winners, 0) < s.record_count OR s.source IS NOT NULL),
  p AS (SELECT *, row_number() OVER (PARTITION BY keyspace_id ORDER BY sequence) AS place,
    CAST(sum(bytes) OVER (PARTITION BY keyspace_id ORDER BY sequence) AS BIGINT) AS input FROM c) SELECT keyspace_id, sequence, winners,
    record_count, input FROM p WHERE place = 1 OR input <= 3000000""")
def compaction_candidates(t):
    return L.candidates(t("segment_records"), t("segments"), 3_000_000)


@query("segments", (
    "SELECT keyspace_id, count(*) % 7 AS full_flushes, CAST(sum(record_count) % 240 AS BIGINT) AS timer_flushes, "
    "count(source) AS shared, count(*) % 7 >= 4 OR sum(record_count) % 240 >= 120 OR count(source) > 1 AS due, "
    "sum(record_count) % 240 >= 120 OR count(source) > 1 AS sweep FROM segments GROUP BY 1"
))
def compaction_due(t):
    """Due after enough full flushes, or enough timer flushes, or with a sweep pending; only the last two sweep."""
    counters = t("segments").groupBy("keyspace_id").agg(
        (F.count("*") % 7).alias("full_flushes"), (F.sum("record_count") % 240).alias("timer_flushes"),
        F.count("source").alias("shared"),
    )
    sweep = (F.col("timer_flushes") >= L.TIMER_FLUSHES) | (F.col("shared") > 1)
    return counters.withColumn("due", (F.col("full_flushes") >= L.FULL_FLUSHES) | sweep).withColumn("sweep", sweep)


@query(USES + " manifests", ALL + (
    f" SELECT w.keyspace_id, w.key, w.lamport AS version, w.value_bytes FROM won w "
    f"JOIN manifests m USING (keyspace_id) WHERE w.key >= m.start_key AND (m.end_key IS NULL OR w.key < m.end_key) "
    f"AND NOT w.deleted AND NOT {EXPIRED}"
))
def snapshot_read(t):
    """Runs under a manifest: records out of its range do not count, the newest wins, then visibility."""
    ranges = F.broadcast(t("manifests").select("keyspace_id", "start_key", "end_key"))
    inside = t("segment_records").join(ranges, "keyspace_id").where(in_range(F.col("key"), F.col("start_key"), F.col("end_key")))
    return L.merge_full(inside, _mid(t)).where("NOT deleted").select(*S.KEY, F.col("lamport").alias("version"), "value_bytes")


@query("")
def external_values_check(t):
    """Value objects against the length and CRC32C that records name; every fiftieth record is wrong in one of them."""
    body = F.col("text").cast("binary")
    rows = t("documents").select("doc_id", F.length(body).alias("size"), crc32c_column(body).alias("crc"))
    claimed = rows.select(
        "doc_id", "size", "crc",
        F.when(F.col("doc_id") % 50 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("length"),
        F.when(F.col("doc_id") % 50 == 2, F.col("crc").bitwiseXOR(F.lit(1))).otherwise(F.col("crc")).alias("crc32c"),
    )
    status = F.when(F.col("size") != F.col("length"), "length").when(F.col("crc") != F.col("crc32c"), "checksum").otherwise("ok")
    return claimed.select("doc_id", "crc32c", status.alias("status"))


@query("segments manifests", """WITH s AS (SELECT keyspace_id, CASE WHEN sequence = 6 THEN replace(name, '.oseg', '.tmp') WHEN sequence = 9
  AND keyspace_id = 1 THEN lead_name ELSE name END AS name, source, CASE WHEN sequence = 4 AND keyspace_id = 0 THEN 95
  ELSE bytes END AS bytes, CASE WHEN sequence = 5 AND keyspace_id = 4 THEN 0 ELSE record_count END AS record_count, min_key, max_key,
  min_lamport, max_lamport, sequence
    FROM (SELECT *, lag(name) OVER (PARTITION BY keyspace_id ORDER BY sequence) AS lead_name FROM segments)),
  c AS (SELECT s.*, m.committed, m.start_key, m.end_key, count(*) OVER (PARTITION BY s.keyspace_id, s.source, s.name) AS same FROM s
    JOIN manifests m USING (keyspace_id))
  SELECT keyspace_id, sequence, unnest(list_filter([CASE WHEN same > 1 THEN 'listed twice' END, CASE
    WHEN NOT regexp_full_match(name, 'segments/[0-9a-f]{16}-[0-9a-f]{16}[.]oseg') THEN 'name' END, CASE
    WHEN record_count = 0 THEN 'no records' END, CASE WHEN bytes < 96 THEN 'too small' END,
    CASE WHEN min_key < start_key OR max_key >= end_key THEN 'out of range' END, CASE
      WHEN max_lamport > committed THEN 'above committed' END, CASE WHEN source = keyspace_id THEN 'own source' END],
      lambda x: x IS NOT NULL)) AS fault FROM c""")
def manifest_violations(t):
    """Every rule that an entry breaks; some entries are spoilt to break one."""
    before = F.lag("name").over(Window.partitionBy("keyspace_id").orderBy("sequence"))
    at = lambda s, k: (F.col("sequence") == s) & (F.col("keyspace_id") == k)
    name = F.when(
        F.col("sequence") == 6, F.replace(F.col("name"), F.lit(".oseg"), F.lit(".tmp")),
    ).when(at(9, 1), before).otherwise(F.col("name"))
    rows = t("segments").select(
        "keyspace_id", "sequence", name.alias("name"), "source",
        F.when(at(4, 0), 95).otherwise(F.col("bytes")).alias("bytes"),
        F.when(at(5, 4), 0).otherwise(F.col("record_count")).alias("record_count"), "min_key", "max_key",
        "min_lamport", "max_lamport",
    )
    rows = rows.withColumn(
        "same", F.count("*").over(Window.partitionBy("keyspace_id", "source", "name")),
    ).join(F.broadcast(t("manifests")), "keyspace_id")
    rules = {
        "listed twice": F.col("same") > 1, "name": ~F.col("name").rlike(r"^segments/[0-9a-f]{16}-[0-9a-f]{16}\.oseg$"), "no records": F.col("record_count") == 0, "too small": F.col("bytes") < 96,
        "key order": F.col("min_key") > F.col("max_key"), "out of range": (F.col("min_key") < F.col("start_key")) | (F.col("max_key") >= F.col("end_key")), "lamport order": F.col("min_lamport") > F.col("max_lamport"),
        "above committed": F.col("max_lamport") > F.col("committed"), "own source": F.col("source") == F.col("keyspace_id"),
    }
    return rows.select(
        "keyspace_id", "sequence",
        F.explode(F.array_compact(F.array(*[F.when(broken, k) for k, broken in rules.items()]))).alias("fault"),
    )


REFERENCED = (
    "r AS (SELECT keyspace_id, name FROM segments WHERE sequence % 3 <> 1 UNION SELECT keyspace_id, "
    "replace(replace(name, 'segments/', 'values/'), '.oseg', '.oval') FROM segments WHERE sequence % 4 = 0)"
)
ORPHANS = (
    r"SELECT * FROM objects o "
    r"WHERE regexp_full_match(name, '(segments/[0-9a-f]{16}-[0-9a-f]{16}\.oseg|values/[0-9a-f]{16}-[0-9a-f]{16}\.oval)') "
    r"AND NOT EXISTS (SELECT 1 FROM r WHERE r.keyspace_id = o.keyspace_id AND r.name = o.name)"
)


def referenced(t):
    runs = t("segments")
    value = F.replace(F.replace(F.col("name"), F.lit("segments/"), F.lit("values/")), F.lit(".oseg"), F.lit(".oval"))
    return runs.where("sequence % 3 <> 1").select("keyspace_id", "name").union(runs.where("sequence % 4 = 0").select("keyspace_id", value))


@query("segments objects", f"WITH {REFERENCED} SELECT keyspace_id, name, bytes FROM ({ORPHANS})")
def orphan_objects(t):
    return L.orphans(t("objects"), referenced(t)).select("keyspace_id", "name", "bytes")


@query("segments objects manifests", (
    f"WITH {REFERENCED} SELECT o.keyspace_id, o.name, CASE WHEN 1700009000000 - m.modified_millis > 3900000 "
    f"AND coalesce(1700009000000 - o.modified_millis > 3900000, FALSE) THEN 'delete' ELSE 'retain' END AS verdict "
    f"FROM ({ORPHANS}) o JOIN manifests m USING (keyspace_id)"
))
def sweep_plan(t):
    return L.sweep(t("objects"), referenced(t), t("manifests"), 1_700_009_000_000)


@query("objects", r"""SELECT name, count(*) AS n, CASE
  WHEN regexp_full_match(name, 'segments/[0-9a-f]{16}-[0-9a-f]{16}\.oseg') THEN 'segment'
  WHEN regexp_full_match(name, 'values/[0-9a-f]{16}-[0-9a-f]{16}\.oval') THEN 'value' END AS kind,
  CASE WHEN kind IS NOT NULL THEN ('0x' || regexp_extract(name, '/([0-9a-f]{16})', 1))::BIGINT END AS epoch, CASE
    WHEN kind IS NOT NULL THEN ('0x' || regexp_extract(name, '-([0-9a-f]{16})', 1))::BIGINT END AS sequence FROM objects GROUP BY name""")
def parse_object_names(t):
    names = t("objects").groupBy("name").agg(F.count("*").alias("n")).withColumn("p", L.parsed_name(F.col("name")))
    return names.select(
        "name", "n", "p.kind", F.col("p.epoch").cast("long").alias("epoch"),
        F.col("p.sequence").cast("long").alias("sequence"),
    )


@query("segments manifests", (
    "SELECT m.keyspace_id, e.e AS epoch, coalesce(max(s.sequence) + 1, 0) AS next FROM manifests m CROSS "
    "JOIN (VALUES (1), (2), (3)) AS e(e) LEFT JOIN segments s ON s.keyspace_id = m.keyspace_id "
    "AND s.keyspace_id + 1 = e.e GROUP BY 1, 2"
))
def next_sequence(t):
    """One above the largest sequence among a manifest's own epoch's names, else 0."""
    wanted = t("manifests").select("keyspace_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("epoch"))
    own = t("segments").select("keyspace_id", L.parsed_name(F.col("name")).alias("p")).select(
        "keyspace_id", F.col("p.epoch").cast("int").alias("epoch"),
        F.col("p.sequence").cast("long").alias("sequence"),
    )
    top = own.groupBy("keyspace_id", "epoch").agg(F.max("sequence").alias("top"))
    return wanted.join(top, ["keyspace_id", "epoch"], "left").select(
        "keyspace_id", "epoch", F.coalesce(F.col("top") + 1, F.lit(0)).alias("next"),
    )


@query("segments", (
    "SELECT source, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT name) AS n FROM segments "
    "WHERE source IS NOT NULL GROUP BY 1"
))
def shared_segments(t):
    names = F.array_sort(F.collect_set("name"))
    return t("segments").where("source IS NOT NULL").groupBy("source").agg(
        F.array_join(names, ",").alias("names"), F.size(F.collect_set("name")).cast("long").alias("n"),
    )


@query("segment_records", (
    "SELECT keyspace_id, key, lamport, expires_at_millis, deleted, CASE WHEN NOT deleted THEN repeat('v', "
    "CAST(value_bytes % 97 AS INT)) END AS value FROM segment_records"
))
def read_segment_file(t):
    """All runs written in the segment format to the shared folder and read back, every checksum checked. The log has sizes and no values: these are made up."""
    rows = t("segment_records")
    folder = f"{shared_folder(rows.sparkSession)}/segments/{uuid.uuid4().hex}"
    value = F.when(~F.col("deleted"), F.repeat(F.lit("v"), (F.col("value_bytes") % 97).cast("int")).cast("binary"))
    write_segments(
        rows.select(
            "keyspace_id", "sequence", F.col("key").cast("binary").alias("key"), "lamport",
            "expires_at_millis", "deleted", value.alias("value"),
        ),
        folder,
    )
    return read_objects(rows.sparkSession, folder).select(
        "keyspace_id", F.col("key").cast("string").alias("key"), "lamport", "expires_at_millis", "deleted",
        F.col("value").cast("string").alias("value"),
    )


@query(USES, ALL + (
    ", l AS (SELECT keyspace_id, sum(40 + length(key) + value_bytes) AS live FROM won GROUP BY 1) "
    "SELECT s.keyspace_id, CAST(sum(bytes) AS BIGINT) AS total, CAST(any_value(live) AS BIGINT) AS live, "
    "sum(bytes)::DOUBLE / any_value(live)::DOUBLE AS amplification FROM segments s JOIN l USING (keyspace_id) "
    "GROUP BY 1"
))
def space_amplification(t):
    alive = L.winners(t("segment_records")).groupBy("keyspace_id").agg(F.sum(F.lit(40) + F.octet_length("key") + F.col("value_bytes")).alias("live"))
    total = t("segments").groupBy("keyspace_id").agg(F.sum("bytes").alias("total"))
    return total.join(alive, "keyspace_id").select("keyspace_id", "total", "live", F.try_divide("total", "live").alias("amplification"))
