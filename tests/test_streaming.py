"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from tests.test_model import REQUEST, model, requests
from tidemark.operators import admission as A
from tidemark.operators import state as S
from tidemark.streaming import jobs


def streamed(spark, rows, schema, tmp_path, job, mode, keys, parts=3):
    """Feed rows in parts, in order, and keep the last row a key."""
    folder, out = tmp_path / "in", {}
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

        def keep(batch, _):
            out.update({tuple(r[k] for k in keys): tuple(r) for r in batch.collect()})

        job(source).writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_replay(spark, tmp_path):
    schema = "keyspace_id long, key string, lamport long, deleted boolean, value_bytes long, expires_at_millis long"
    rows = [(1, f"k{i * 7 % 11}", i, i % 5 == 0, i, None) for i in range(1, 90)]
    got = streamed(spark, rows + rows[:20], schema, tmp_path, jobs.replay, "update", ["keyspace_id", "key"])
    assert sorted(got.values()) == sorted(map(tuple, S.replay(spark.createDataFrame(rows, schema)).collect()))


def test_cas(spark, tmp_path):
    rows = requests(7, 300)
    got = streamed(spark, rows, REQUEST, tmp_path, jobs.cas, "append", ["lamport"])
    assert {k[0]: v[4:] for k, v in got.items()} == model(rows)


def test_rate_limit(spark, tmp_path):
    schema = "bucket string, place long, at_micros long, rate long"
    rows = [("a" if i % 3 else "b", i, i * 90_000, 3 if i % 3 else None) for i in range(120)]
    got = streamed(spark, rows, schema, tmp_path, jobs.rate_limit, "append", ["bucket", "place"])
    assert sorted(got.values()) == sorted(map(tuple, A.token_buckets(spark.createDataFrame(rows, schema)).select("bucket", "place", "admitted").collect()))


def test_health(spark, tmp_path):
    rows = [(1, 1000, 1500), (2, 1000, 1500), (1, 4000, 4500), (2, 1000, 4500), (3, 3000, 4500)]
    got = streamed(spark, rows, "node_id long, heard_millis long, now_millis long", tmp_path, jobs.node_health, "update", ["node_id"])
    assert {k[0]: v[2] for k, v in got.items()} == {1: "healthy", 2: "dead", 3: "suspect"}


@pytest.mark.parametrize("copies", [2])
def test_dedup(spark, tmp_path, copies):
    schema = "keyspace_id long, lamport long, at timestamp"
    rows = [tuple(r) for r in spark.range(40).select(F.lit(1).cast("long"), F.col("id") % 25, F.timestamp_seconds(F.col("id") + 1_700_000_000)).collect()]
    got = []
    folder = tmp_path / "in"
    spark.createDataFrame(rows * copies, schema).coalesce(1).write.parquet(str(folder))
    jobs.dedup(spark.readStream.schema(schema).parquet(str(folder))).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["lamport"] for r in got) == list(range(25))
