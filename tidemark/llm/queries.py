"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, fuzzy_lines, langid, matroska, mixing, quality, secrets, sharding, simhash, toolcalls
from tidemark.llm.common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.fair_queue(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "finish")


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(matroska.with_media(table(spark, sf_dir, "documents")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_groups(table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = toolcalls.in_order(toolcalls.of_conversations(table(spark, sf_dir, "conversations")))
    ids = (F.col(c).cast("long").alias(n) for c, n in (("thread", "conv_id"), ("call_id", "turn")))
    return linked.select(*ids, "kind", "name", "level", "n_results", F.array_join("errors", ",").alias("errors"), "json", "place")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.train(docs))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR,
    text, '')) AS digest
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT source, source_size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight FROM s),
r AS (SELECT *, (source_size * 3)::DOUBLE AS most, (source_size * 3)::DOUBLE / weight AS full_at FROM w),
v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER e, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level
  FROM r WINDOW e AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weight, least(most, coalesce(weight * max(level) FILTER (level <= full_at) OVER (), most)) AS target
  FROM v),
q AS (
  SELECT d.*, t.source_size, t.target, t.weight, floor(t.target + 1e-6)::BIGINT AS words,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (start + size) / weight AS finish,
  CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size,
    words % source_size - start)) END::BIGINT AS taken
FROM q
"""

OP8_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, text, role IS DISTINCT FROM 'assistant' AS calls, CASE WHEN role = 'user' THEN 'reply'
  ELSE 'configure' END AS name FROM conversations),
c AS (
  SELECT *, CASE WHEN EXISTS (SELECT 1 FROM t AS b WHERE b.calls AND b.conv_id = t.conv_id AND b.turn + 1 = t.turn) THEN turn - 1
    WHEN turn >= 2 THEN turn - 2 END AS previous
  FROM t WHERE calls),
n AS (SELECT DISTINCT conv_id, turn, previous, EXISTS (SELECT 1 FROM c AS b WHERE b.conv_id = c.conv_id AND b.turn = c.previous) AS met
  FROM c),
l AS (
  SELECT conv_id, turn, 0 AS level FROM n WHERE NOT met
  UNION ALL SELECT n.conv_id, n.turn, l.level + 1 FROM n JOIN l ON n.conv_id = l.conv_id AND n.previous = l.turn AND n.met),
e AS (SELECT conv_id, turn - 1 AS turn, text AS content, count(*) AS n FROM t WHERE NOT calls GROUP BY 1, 2, 3),
r AS (SELECT conv_id, turn, min(content) AS content, sum(n)::BIGINT AS n_results FROM e GROUP BY 1, 2),
o AS (
  SELECT c.conv_id, c.turn, 'call' AS kind, c.name, l.level, coalesce(r.n_results, 0) AS n_results,
    concat_ws(',', CASE WHEN c.name = 'reply' AND c.previous IS NULL THEN 'missing previous' END, CASE
      WHEN c.text IS NULL THEN 'missing text' END, CASE WHEN c.name = 'configure' THEN 'type turn' END,
      CASE WHEN c.previous IS NOT NULL AND NOT n.met THEN 'need' END) AS errors,
    '{"arguments":{' || CASE WHEN c.previous IS NULL THEN '' ELSE '"previous":' || c.previous || ',' END || CASE WHEN c.text IS NULL THEN '' ELSE '"text":' || to_json(c.text)::VARCHAR || ',' END
      || '"turn":' || c.turn || '},"call_id":"' || c.turn || '","name":"' || c.name || '","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
  FROM c JOIN n USING (conv_id, turn) JOIN l USING (conv_id, turn) LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn
  UNION ALL
  SELECT x.conv_id, x.turn, 'result', NULL, NULL, x.n,
    x.error, '{"arguments":null,"call_id":"' || x.turn || '","name":null,"result":' || coalesce(to_json(x.content)::VARCHAR, 'null') || '}'
  FROM (
    SELECT r.conv_id, r.turn, r.content, r.n_results AS n, 'call' AS error FROM r ANTI JOIN c ON r.conv_id = c.conv_id AND r.turn = c.turn
    UNION ALL SELECT e.conv_id, e.turn, e.content, e.n, 'repeated' FROM e JOIN r ON e.conv_id = r.conv_id AND e.turn = r.turn
      AND e.content <> r.content) AS x)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn::VARCHAR, kind, json) - 1 AS place FROM o
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
i AS (SELECT item_id, ws, least(5, len(ws)) AS n FROM (SELECT item_id,
  regexp_extract_all(lower(text), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark) WHERE len(ws) > 0),
own AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k + n - 1], ' '))) AS s
  FROM i),
sizes AS (SELECT item_id, count(*) AS shingles FROM own GROUP BY 1),
cut AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k + n - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)
SELECT doc_id, item_id, count(*) AS shared, shingles, count(*) / shingles AS containment
FROM cut JOIN own USING (n, s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, shingles HAVING count(*) >= 0.8 * shingles - 1e-9
"""

#: The crc32 of a text, byte by byte, by the public table rule.
OP7_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS place, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT place, CASE
  WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
lookup AS (SELECT list(c ORDER BY place) AS crc FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS raw FROM documents),
k AS (
  SELECT doc_id, length(raw) // 2 + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(raw) // 2), lambda i: ('0x' || raw[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32,
    ('0x' || md5(text)[1:7])::BIGINT * 4294967296 + ('0x' || md5(concat_ws(':', doc_id::VARCHAR, length(text)::VARCHAR))[1:8])::BIGINT AS key
  FROM d, lookup),
p AS (SELECT *, sum(size) OVER (ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) - sum(size) OVER (PARTITION BY key) AS below, sum(size) OVER () AS total, greatest(8,
  ceil((sum(size) OVER ()) / 24 / 67108864))::BIGINT AS per FROM k),
q AS (SELECT *, (below * (24 * per)) // total // per AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY key,
  doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM q
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix, "op2_matroska": op2_matroska, "op3_secrets": op3_secrets,
    "op4_decontaminate": op4_decontaminate, "op5_quality": op5_quality, "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_shards": op7_shards, "op8_tool_calls": op8_tool_calls, "op9_simhash": op9_simhash,
    "op10_language": op10_language,
}
ORACLES: dict[str, str] = {"op1_mix": OP1_SQL, "op4_decontaminate": OP4_SQL, "op7_shards": OP7_SQL, "op8_tool_calls": OP8_SQL}
