"""Admission, authorization and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import admission as A
from tidemark.plans.controlling import SERVING, VIEW, keyspace_totals, serving
from tidemark.plans.registry import query

BUCKET = """WITH RECURSIVE q AS (SELECT b.*, k.rate, row_number() OVER (PARTITION BY bucket ORDER BY place) AS n
  FROM (SELECT user_id % 5 AS keyspace_id, concat(user_id % 5, CASE WHEN event_type = 'view' THEN 'r' ELSE 'w' END) AS bucket,
  event_type = 'view' AS reads, event_id AS place, epoch_us(ts) // 100000 AS at_micros FROM events) b
    JOIN (SELECT keyspace_id, TRUE AS reads, reads_per_second AS rate FROM keyspaces UNION ALL SELECT keyspace_id, FALSE, writes_per_second
      FROM keyspaces) k ON k.keyspace_id = b.keyspace_id AND k.reads = b.reads),
  f AS (SELECT bucket, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS place, rate * 1000 AS tokens, at_micros AS last, FALSE AS admitted
    FROM q WHERE n = 1 AND rate IS NOT NULL
    UNION ALL SELECT bucket, n, place, tokens - CASE WHEN tokens >= 1000 THEN 1000 ELSE 0 END, last, tokens >= 1000 FROM (SELECT q.bucket,
      q.n, q.place, CASE WHEN (greatest(q.at_micros - f.last, 0) * q.rate) // 1000 > 0 THEN least(f.tokens + (greatest(q.at_micros - f.last, 0) * q.rate) // 1000, q.rate * 1000) ELSE f.tokens END AS tokens,
      CASE WHEN (greatest(q.at_micros - f.last, 0) * q.rate) // 1000 > 0 THEN q.at_micros ELSE f.last END AS last FROM f
        JOIN q ON q.bucket = f.bucket AND q.n = f.n + 1))
  SELECT place, bucket, admitted FROM f WHERE n > 0 UNION ALL SELECT place, bucket, TRUE FROM q WHERE rate IS NULL"""


@query("keyspaces", BUCKET)
def rate_limit(t):
    """Every request against its keyspace's read or write bucket (time runs here at a hundred-thousandth)."""
    rates = t("keyspaces").select(
        "keyspace_id",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("reads"), F.col("reads_per_second").alias("rate")),
                F.struct(F.lit(False).alias("reads"), F.col("writes_per_second").alias("rate")),
            )
        ).alias("r"),
    ).select("keyspace_id", "r.*")
    reads = F.col("event_type") == "view"
    micros = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100_000)
    rows = t("events").select(
        (F.col("user_id") % 5).alias("keyspace_id"), reads.alias("reads"),
        F.concat((F.col("user_id") % 5).cast("string"), F.when(reads, "r").otherwise("w")).alias("bucket"),
        F.col("event_id").alias("place"), micros.alias("at_micros"),
    )
    return A.token_buckets(
        rows.join(F.broadcast(rates), ["keyspace_id", "reads"]).select("bucket", "place", "at_micros", "rate")
    ).select("place", "bucket", "admitted")


@query("keyspaces partition_map replicas", (
    f"WITH {SERVING} SELECT name, CASE WHEN reads_per_second = 0 THEN 0 ELSE greatest(reads_per_second // readers, "
    f"CASE WHEN reads_per_second IS NOT NULL THEN 1 END) END AS reads, CASE WHEN writes_per_second = 0 THEN 0 "
    f"ELSE greatest(writes_per_second // writers, CASE WHEN writes_per_second IS NOT NULL THEN 1 END) END AS writes "
    f"FROM keyspaces JOIN sv USING (keyspace_id)"
).replace("reads_per_second = 0 THEN 0", "reads_per_second IS NULL THEN NULL WHEN reads_per_second = 0 THEN 0").replace(
    "writes_per_second = 0 THEN 0", "writes_per_second IS NULL THEN NULL WHEN writes_per_second = 0 THEN 0",
))
def rate_shares(t):
    rows = t("keyspaces").join(serving(t), "keyspace_id")
    return rows.select(
        "name", A.rate_share(F.col("reads_per_second"), F.col("readers")).alias("reads"),
        A.rate_share(F.col("writes_per_second"), F.col("writers")).alias("writes"),
    )


@query("mutation_log keyspaces partition_map replicas node_status", (
    f"WITH {VIEW}, sv AS (SELECT keyspace_id, greatest(count(DISTINCT owner), 1) AS writers FROM partition_map "
    f"GROUP BY 1), h AS (SELECT keyspace_id, coalesce(sum(size_bytes), 0) AS held FROM v GROUP BY 1) "
    f"SELECT m.keyspace_id, count(*) AS asked, count(*) FILTER (k.max_storage_bytes IS NOT NULL "
    f"AND h.held + length(m.key) + m.value_bytes + 64 > k.max_storage_bytes // sv.writers) AS refused "
    f"FROM mutation_log m JOIN keyspaces k USING (keyspace_id) JOIN sv USING (keyspace_id) "
    f"JOIN h USING (keyspace_id) WHERE m.op = 'put' GROUP BY 1"
))
def storage_admission(t):
    """A write is refused when what its keyspace holds and it together pass the owner's part of the quota."""
    held = keyspace_totals(t).select("keyspace_id", F.col("stored_bytes").alias("held"))
    limits = t("keyspaces").select("keyspace_id", "max_storage_bytes").join(held, "keyspace_id").join(serving(t).select("keyspace_id", "writers"), "keyspace_id")
    size = F.octet_length("key") + F.col("value_bytes") + 64
    refused = F.coalesce(F.col("held") + size > F.floor(F.col("max_storage_bytes") / F.col("writers")), F.lit(False))
    return t("mutation_log").where("op = 'put'").join(F.broadcast(limits), "keyspace_id").groupBy("keyspace_id").agg(
        F.count("*").alias("asked"), F.count_if(refused).alias("refused"),
    )


VERDICT = """WITH q AS (SELECT *, CASE WHEN header LIKE 'Bearer %' THEN sha256(substr(header, 8)) END AS secret_hash FROM requests)
  SELECT {out} FROM (SELECT q.request_id, CASE WHEN q.secret_hash IS NULL THEN 'unauthenticated'
    WHEN q.secret_hash = sha256('root-secret') THEN 'allowed' WHEN q.now_millis - 1700000000000 > 150000 THEN 'unavailable'
    WHEN c.credential_id IS NULL THEN 'unauthenticated'
    WHEN c.keyspace_id = q.keyspace_id AND list_contains(string_split(c.permissions, ','), q.permission)
      AND coalesce(c.expires_at_millis > q.now_millis, TRUE) THEN 'allowed' ELSE 'denied' END AS verdict FROM q LEFT
      JOIN credentials c ON c.secret_hash = q.secret_hash)"""
ROOT = "root-secret"


def _root_hash() -> str:
    import hashlib

    return hashlib.sha256(ROOT.encode()).hexdigest()


@query("requests credentials", VERDICT.replace("{out}", "request_id, verdict"))
def authorize(t):
    rows = A.authorize(t("requests"), t("credentials"), _root_hash(), 1_700_000_000_000, 150_000)
    return rows.select("request_id", "verdict")


@query("requests", (
    "SELECT CASE WHEN header = 'Bearer root-secret' THEN 'allowed' WHEN header LIKE 'Bearer %' THEN 'denied' "
    "ELSE 'unauthenticated' END AS verdict, count(*) AS n FROM requests GROUP BY 1"
))
def authorize_admin(t):
    """Only the root administers."""
    secret = F.regexp_extract("header", r"^Bearer (.+)$", 1)
    verdict = F.when(secret == "", "unauthenticated").when(F.sha2(secret, 256) == _root_hash(), "allowed").otherwise("denied")
    return t("requests").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("", """SELECT o_orderkey, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0::DOUBLE)
  WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1f GiB',
  n / 1073741824.0::DOUBLE) ELSE printf('%.1f TiB', n / 1099511627776.0::DOUBLE) END AS shown
  FROM (SELECT o_orderkey, o_orderkey * CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 999 WHEN 2 THEN 1048577 WHEN 3 THEN 1073741823
    ELSE 1099511627777 END AS n FROM orders)""")
def format_bytes(t):
    """``n`` is a long, as in SQL, while every product fits one. Where one does not, SQL itself overflows: there ``n`` is an exact decimal."""
    key, pick = F.col("o_orderkey"), F.col("o_orderkey") % 5
    scale = F.when(pick == 0, 1).when(pick == 1, 999).when(pick == 2, 1048577).when(pick == 3, 1073741823).otherwise(1099511627777).cast("long")
    wide = t("orders").agg(F.bool_or(key.isNotNull() & F.try_multiply(key, scale).isNull())).first()[0]
    n = key.cast("decimal(19,0)") * scale.cast("decimal(19,0)") if wide else key * scale
    return t("orders").select("o_orderkey", n.alias("n")).withColumn("shown", A.format_bytes(F.col("n")))


@query("mutation_log", (
    "SELECT lamport, strftime(make_timestamp(now_millis // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS shown "
    "FROM mutation_log"
))
def format_millis(t):
    return t("mutation_log").select("lamport", A.format_millis(F.col("now_millis")).alias("shown"))


@query("", (
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'base64:' || to_base64(unhex('FF') || encode(url)) "
    "ELSE url END AS shown FROM pages"
))
def blob_display(t):
    raw = F.col("url").cast("binary")
    return t("pages").select(
        "page_id",
        A.blob_display(F.when(F.col("page_id") % 3 == 0, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw)).alias("shown"),
    )


@query("", """SELECT p_partkey, text, CASE WHEN text = '0' THEN 0
  WHEN regexp_full_match(trim(text), '[0-9]+(ms|s|m|h|d)') THEN CAST(regexp_extract(trim(text), '[0-9]+') AS BIGINT) * CASE regexp_extract(trim(text), '[a-z]+') WHEN 'ms' THEN 1 WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 ELSE 86400000 END END AS millis
  FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '0' WHEN 1 THEN p_size || 'ms' WHEN 2 THEN p_size || 's'
    WHEN 3 THEN ' ' || p_size || 'm ' WHEN 4 THEN p_size || 'h' WHEN 5 THEN p_size || 'd' WHEN 6 THEN CAST(p_size AS VARCHAR)
    ELSE p_size || 'w' END AS text FROM part)""")
def parse_duration(t):
    size, pick = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    text = F.when(pick == 0, "0").when(pick == 1, F.concat(size, F.lit("ms"))).when(pick == 2, F.concat(size, F.lit("s"))).when(pick == 3, F.concat(F.lit(" "), size, F.lit("m "))).when(pick == 4, F.concat(size, F.lit("h"))).when(pick == 5, F.concat(size, F.lit("d"))).when(pick == 6, size).otherwise(F.concat(size, F.lit("w")))
    return t("part").select("p_partkey", text.alias("text")).withColumn("millis", A.parse_duration(F.col("text")))
