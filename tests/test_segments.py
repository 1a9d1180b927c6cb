"""Segments at size: checksums in step, many segments together, groups across batches."""

import random
import time

import pytest

from tidemark.functions.crc32c import PLAIN, checksum, crc32c
from tidemark.sources import segment as G


def records(rng, n):
    kinds = lambda i: [(None, b"v" * rng.randrange(97)), (5, b""), (9, None)][i % 3]
    return [G.Record(b"k/%06d" % i, rng.randrange(2**40), *kinds(i)) for i in range(n)]


def test_long_segments_take_little_time():
    own = [*records(random.Random(1), 500), G.Record(b"long", 7, None, bytes(range(250)) * 1200)]
    began = time.process_time()
    assert G.decode(G.encode(own, 1, 2, 3)) == (1, 2, own)
    assert time.process_time() - began < 5


def test_checksums_of_all_lengths():
    def plain(row):
        x = 0xFFFFFFFF
        for b in row or b"":
            x = PLAIN[(x ^ b) & 255] ^ (x >> 8)
        return x ^ 0xFFFFFFFF

    rng = random.Random(2)
    rows = [None, b"", *(rng.randbytes(n) for n in [*range(1, 140), 1023, 1024, 1025, 70_001]), b"\0" * 300, b"123456789"]
    assert crc32c(rows).tolist() == [plain(r) for r in rows] == [checksum(r or b"") for r in rows]
    assert checksum(b"123456789") == 0xE3069283 and len(crc32c([])) == 0


def test_many_together_are_as_each_alone():
    rng = random.Random(3)
    many = [(records(rng, rng.randrange(1, 40)), k, k + 1, k + 2) for k in range(30)]
    raws = G.encode_all(many)
    assert raws == [G.encode(*one) for one in many]
    assert G.decode_all(raws) == [(k, p, own) for own, k, p, _ in many]
    for place in (32, len(raws[17]) // 2, len(raws[17]) - 70, len(raws[17]) - 30):
        broken = bytearray(raws[17])
        broken[place] ^= 1
        with pytest.raises(G.Corrupt):
            G.decode_all([*raws[:17], bytes(broken), *raws[18:]])
    with pytest.raises(ValueError):
        G.encode_all([*many, (many[0][0][:1] * 2, 1, 1, 1)])


def test_groups_go_on_across_batches(spark, tmp_path):
    rows = [(k, s, b"k%03d" % i, i, None if i % 2 else i, i % 5 == 0, b"v" * (i % 9)) for k in (1, 2) for s in (0, 1, 2) for i in range(40)]
    frame = spark.createDataFrame(
        random.Random(4).sample(rows, len(rows)),
        "keyspace_id long, sequence long, key binary, lamport long, expires_at_millis long, deleted boolean, value binary",
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        G.write_segments(frame, str(tmp_path / "objects"))
        names = [r["name"] for r in spark.read.parquet(str(tmp_path / "objects")).collect()]
        got = G.read_objects(spark, str(tmp_path / "objects")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(names) == [f"segments/{k:016x}-{s:016x}.oseg" for k in (1, 2) for s in (0, 1, 2)]
    want = sorted((k, key, at, expires or -1, deleted, b"-" if deleted else value) for k, _, key, at, expires, deleted, value in rows)
    assert sorted((
        r["keyspace_id"], bytes(r["key"]), r["lamport"], r["expires_at_millis"] or -1, r["deleted"],
        b"-" if r["value"] is None else bytes(r["value"]),
    ) for r in got) == want
