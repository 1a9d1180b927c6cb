"""The engine's input tables, derived from the driver's, for Spark and for the SQL oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# US(x): microseconds since 1970 of a timestamp. JK(x): member k of a JSON text. a DIV b: integer division.
FIXTURES: dict[str, str] = {
    # Requests on a versioned store, one an event, in order of lamport.
    "mutation_log": """
        SELECT CAST(user_id % 5 AS BIGINT) AS keyspace_id, event_id + 1 AS lamport,
          concat('u/', lpad(CAST(user_id AS STRING), 6, '0'), '/', CAST(CAST(JK(props) AS INT) % 4 AS STRING)) AS key,
          CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'get' ELSE 'put' END AS op,
          CASE WHEN event_type = 'signup' THEN 'if_not_present' WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'if_version'
            ELSE 'none' END AS cond,
          CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN lag(event_id + 1) OVER (PARTITION BY user_id,
            CAST(JK(props) AS INT) % 4 ORDER BY event_id) END AS expected,
          CASE WHEN event_type = 'purchase' THEN 21600000 WHEN event_id % 11 = 0 THEN 864000000 END AS ttl_millis,
          US(ts) DIV 1000 AS now_millis, CAST(round(value * 100) AS BIGINT) AS value_bytes
        FROM {events}""",
    # The writes of that log as a partition applies them: what a read and the conditions left out.
    "mutations": """
        SELECT m.keyspace_id, m.lamport, m.key, m.op = 'delete' AS deleted, CASE WHEN m.op = 'put' THEN m.value_bytes
          ELSE 0 END AS value_bytes,
          CASE WHEN m.op = 'delete' THEN m.now_millis + 86400000 ELSE m.now_millis + coalesce(m.ttl_millis,
            k.default_ttl_millis) END AS expires_at_millis
        FROM {mutation_log} m JOIN {keyspaces} k ON m.keyspace_id = k.keyspace_id WHERE m.op <> 'get'""",
    "keyspaces": """
        SELECT CAST(r_regionkey AS BIGINT) AS keyspace_id, replace(lower(r_name), ' ', '-') AS name,
          CASE WHEN r_regionkey % 2 = 0 THEN CAST(2592000000 AS BIGINT) END AS default_ttl_millis,
          CAST(CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN 1048576 ELSE 1000 * r_regionkey END AS BIGINT) AS max_value_bytes,
          CAST(CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 50000 ELSE 5000000 END AS BIGINT) AS max_storage_bytes,
          CAST(CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 * r_regionkey END AS BIGINT) AS reads_per_second,
          CAST(CASE r_regionkey WHEN 3 THEN NULL WHEN 4 THEN 0 ELSE r_regionkey + 1 END AS BIGINT) AS writes_per_second
        FROM {region}""",
    "partition_map": """
        SELECT CAST(n_regionkey AS BIGINT) AS keyspace_id, CAST(n_nationkey AS BIGINT) AS partition_id,
          CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) = 1 THEN '' ELSE n_name END AS start_key,
          lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS end_key,
          CASE WHEN n_nationkey = 13 THEN NULL WHEN n_nationkey % 4 = 0 THEN CAST(3 AS BIGINT)
            ELSE CAST(1 + (n_nationkey * 3) % 10 AS BIGINT) END AS owner, CAST(1 + n_nationkey % 4 AS BIGINT) AS epoch,
          CASE WHEN n_nationkey = 13 THEN 'unowned' WHEN n_nationkey % 8 = 5 THEN 'fenced' ELSE 'serving' END AS phase,
            CAST(3 + n_nationkey % 2 AS BIGINT) AS fence_map_version
        FROM {nation}""",
    # The same map with ranges moved, dropped and doubled, for the checks.
    "broken_map": """
        SELECT keyspace_id, partition_id, CASE WHEN partition_id = 7 THEN concat(start_key, 'Z') ELSE start_key END AS start_key,
          CASE WHEN partition_id = 12 THEN concat(end_key, 'Z') WHEN partition_id % 9 = 4 AND end_key IS NULL THEN 'ZZZ'
            ELSE end_key END AS end_key
        FROM {partition_map} WHERE partition_id NOT IN (2, 0, 24)""",
    "replicas": """
        SELECT p.keyspace_id, p.partition_id, CAST(1 + (p.partition_id * 3 + i.i * (1 + p.partition_id % 3)) % 10 AS BIGINT) AS node_id,
          CAST(i.i AS INT) AS position
        FROM {partition_map} p CROSS JOIN (VALUES (1), (2)) AS i(i) WHERE p.partition_id <> 20 AND p.owner IS DISTINCT
          FROM 1 + (p.partition_id * 3 + i.i * (1 + p.partition_id % 3)) % 10""",
    "nodes": """
        SELECT s_suppkey AS node_id, CASE WHEN s_suppkey % 7 = 0 THEN 'control' ELSE 'worker' END AS role, CASE s_suppkey % 10
          WHEN 4 THEN 3200 WHEN 7 THEN 1500 ELSE (s_suppkey * 37) % 900 END AS silent_millis,
          CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE concat('zone-', CAST(s_nationkey % 4 AS STRING)) END AS zone, concat('id-',
            CAST((s_suppkey * 7919) % 1009 AS STRING)) AS node_identity,
          CAST(0 AS BIGINT) AS min_major, CAST(s_suppkey % 2 AS BIGINT) AS min_minor, CAST(0 AS BIGINT) AS max_major, CAST(2 + s_suppkey % 3 AS BIGINT) AS max_minor,
          s_suppkey % 6 <> 5 AS ready, s_suppkey % 9 = 0 AS draining
        FROM {supplier}""",
    "node_status": """
        SELECT partition_id, node_id, CAST(2 + (partition_id + node_id) % 3 AS BIGINT) AS map_version, 1000 + partition_id * 50 - (position * (partition_id % 3)) * 10 AS durable,
          990 + partition_id * 50 - (position * (partition_id % 3)) * 10 AS applied,
          CASE WHEN position = 0 AND partition_id % 6 <> 1 THEN 996 + partition_id * 50 END AS committed,
          CASE WHEN (partition_id + position) % 7 <> 0 THEN 1000000 * (partition_id + 1) + position END AS size_bytes,
          CASE WHEN (partition_id * 3 + position) % 8 <> 0 THEN 5000 * (partition_id + 1) END AS index_bytes
        FROM (SELECT partition_id, node_id, position FROM {replicas} UNION ALL SELECT partition_id, owner, 0 FROM {partition_map}
          WHERE owner IS NOT NULL) x
        WHERE (partition_id + position) % 11 <> 10""",
    # Sorted runs: the newest record of each key among a thousand lamports of a keyspace.
    "segment_records": """
        SELECT keyspace_id, CAST((lamport - 1) DIV 1000 AS BIGINT) AS sequence, key, lamport, deleted, value_bytes, expires_at_millis
        FROM (SELECT *, row_number() OVER (PARTITION BY keyspace_id, (lamport - 1) DIV 1000, key ORDER BY lamport DESC) AS n
          FROM {mutations}) x WHERE n = 1""",
    "segments": """
        SELECT keyspace_id, sequence, concat('segments/', lpad(lower(hex(keyspace_id + 1)), 16, '0'), '-',
          lpad(lower(hex(sequence)), 16, '0'), '.oseg') AS name,
          CAST(96 + sum(40 + length(key) + value_bytes) AS BIGINT) AS bytes, count(*) AS record_count, min(key) AS min_key, max(key) AS max_key, min(lamport) AS min_lamport, max(lamport) AS max_lamport,
          CASE WHEN (keyspace_id + sequence) % 4 = 3 THEN (keyspace_id + 1) % 5 END AS source
        FROM {segment_records} GROUP BY keyspace_id, sequence""",
    "objects": """
        SELECT keyspace_id, name, bytes, CASE WHEN sequence % 5 = 4 THEN NULL ELSE 1700000000000 + sequence * 900000 END AS modified_millis
          FROM {segments}
        UNION ALL SELECT keyspace_id, replace(name, 'segments/', 'values/'), bytes, 1700000000000 + sequence * 300000 FROM {segments}
        UNION ALL SELECT keyspace_id, replace(replace(name, 'segments/', 'values/'), '.oseg', '.oval'),
          bytes, 1700000000000 + sequence * 300000 FROM {segments} WHERE sequence % 2 = 0""",
    "manifests": """
        SELECT keyspace_id, CAST(keyspace_id + 1 AS BIGINT) AS epoch, CAST(max(max_lamport) - CASE WHEN keyspace_id = 3 THEN 5
          ELSE 0 END AS BIGINT) AS committed, 'u/' AS start_key,
          CASE WHEN keyspace_id = 2 THEN 'u/000050' END AS end_key, CAST(1700000000000 AS BIGINT) AS modified_millis
        FROM {segments} GROUP BY keyspace_id""",
    # A write-ahead log a partition: dense lamports, an epoch every 300 of them, a file every 100, some frames damaged.
    "wal": """
        SELECT keyspace_id AS partition_id, position, position AS lamport, CAST(1 + position DIV 300 AS BIGINT) AS epoch,
          CAST(position DIV 100 AS BIGINT) AS file, key,
          CASE WHEN position % 1201 = 1200 THEN 'checksum' WHEN position % 1789 = 1788 THEN 'torn' ELSE 'ok' END AS frame,
            CAST(position DIV 8 AS BIGINT) AS flush
        FROM (SELECT keyspace_id, key, CAST(row_number() OVER (PARTITION BY keyspace_id ORDER BY lamport) AS BIGINT) AS position
          FROM {mutations}) x""",
    "acks": """
        SELECT w.partition_id, n.n AS node_id, max(w.lamport) - n.n * (w.partition_id + 1) * 3 AS acked, CASE WHEN n.n = 4
          AND w.partition_id % 2 = 1 THEN 'stranded' WHEN n.n = 3 AND w.partition_id = 2 THEN 'unestablished' ELSE 'following' END AS status
        FROM {wal} w CROSS JOIN (VALUES (1), (2), (3), (4)) AS n(n) GROUP BY w.partition_id, n.n""",
    "credentials": """
        SELECT c_custkey AS credential_id, sha256(concat('secret-', CAST(c_custkey AS STRING))) AS secret_hash,
          CAST(c_nationkey % 5 AS BIGINT) AS keyspace_id,
          CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'read,write' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'read'
            ELSE 'write' END AS permissions,
          CASE WHEN c_custkey % 5 = 0 THEN 1700000000000 + c_custkey * 1000 END AS expires_at_millis
        FROM {customer}""",
    "requests": """
        SELECT event_id AS request_id, CASE WHEN user_id % 13 = 0 THEN 'Bearer root-secret' WHEN user_id % 17 = 0 THEN 'Basic x'
          WHEN user_id % 7 = 0 THEN 'Bearer nobody'
            ELSE concat('Bearer secret-', CAST(1 + user_id % 150 AS STRING)) END AS header,
          CAST(event_id % 5 AS BIGINT) AS keyspace_id, CASE WHEN event_type = 'view' THEN 'read'
            ELSE 'write' END AS permission, 1700000000000 + (event_id % 200) * 1000 AS now_millis
        FROM {events}""",
    # Reads and writes of a register as clients saw them: overlapping, some with an unknown outcome.
    "op_history": """
        SELECT CAST(user_id % 40 AS BIGINT) AS key, event_id AS op_id, CASE WHEN event_type IN ('view', 'click') THEN 'read'
          ELSE 'write' END AS kind, US(ts) AS invoked,
          CASE WHEN event_id % 19 = 0 THEN NULL ELSE US(ts) + 1000 * (1 + event_id % 700) END AS returned, event_id + 1 AS version
        FROM {events}""",
    "lifecycle": """
        SELECT o_orderkey AS operation_id, CASE WHEN o_orderkey % 3 = 0 THEN 'merge' ELSE 'split' END AS kind, CASE o_orderstatus
          WHEN 'F' THEN 'completed' WHEN 'O' THEN 'aborted' ELSE 'refused' END AS outcome
        FROM {orders}""",
}


def _sides(sql: str, spark: bool) -> str:
    if spark:
        return sql.replace("US(ts)", "unix_micros(CAST(ts AS TIMESTAMP))").replace("JK(props)", "get_json_object(props, '$.k')").replace("sha256(", "sha2(").replace(
            "AS STRING))) AS secret_hash", "AS STRING)), 256) AS secret_hash",
        )
    return sql.replace("US(ts)", "epoch_us(ts)").replace("JK(props)", "json_extract_string(props, '$.k')").replace(" DIV ", " // ")


def _needs(name: str) -> list[str]:
    import string

    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(FIXTURES[name]) if f))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or one of the driver's tables, as a lazy DataFrame."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_sides(FIXTURES[name], True), **{n: fixture(spark, sf_dir, n) for n in _needs(name)})


def with_fixtures(names: str, body: str) -> str:
    """An oracle: ``body`` after WITH and the fixtures it names, in DuckDB's dialect."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in FIXTURES and name not in order:
            for n in _needs(name):
                add(n)
            order.append(name)

    for name in names.split():
        add(name)
    tables = [f"{n} AS ({_sides(FIXTURES[n].format(**{k: k for k in _needs(n)}), False)})" for n in order]
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("RECURSIVE ", "").strip()
    if body.startswith("WITH "):
        tables, body = [*tables, ""], body[5:]
        return f"WITH {recursive}" + ",\n".join(tables[:-1]) + ",\n" + body
    return f"WITH {recursive}" + ",\n".join(tables) + "\n" + body
