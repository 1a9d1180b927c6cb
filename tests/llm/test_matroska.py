import hashlib
import random
import zlib

import pytest

from tidemark.llm import matroska as m
from tidemark.llm import queries


def feature(padded):
    """What the summary of a sound must say, from its samples alone."""
    packets = len(padded) // 576
    clusters = -(-packets // 64)
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(padded, padded[1:]))
    millis = packets * m.NANOS // 1_000_000
    return f"packets={packets};clusters={clusters};cues={clusters};cued={clusters};millis={millis};sum={sum(padded)};squares={sum(b * b for b in padded)};crossings={crossings};error="


def test_deep_nesting_is_an_error():
    data = m.element(m.CLUSTER_TIME, 1)
    for _ in range(3000):
        data = m.element(m.BLOCK_GROUP, data)
    got = m.parse(m.element(m.EBML) + m.element(m.SEGMENT, m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, m.block(1, 0, [b"abc"], 0)), data)))
    assert len(got.packets) == 1 and "elements in each other" in got.error


def test_query_round_trip(spark, small):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op2_matroska(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["media_bytes"] > len(padded) and r["feature"] == feature(padded)


@pytest.mark.parametrize("lacing", [0, m.XIPH, m.FIXED, m.SIZED])
def test_lacing(lacing):
    rng = random.Random(lacing)
    sizes = [1] if not lacing else [70] * 5 if lacing == m.FIXED else [0, 255, 254, 600, 3, 20_000, 510, 1]
    frames = [rng.randbytes(n) for n in sizes]
    body = m.element(m.SEGMENT, m.element(m.VOID, b"12"), m.element(m.CLUSTER, m.element(m.CLUSTER_TIME, 7), m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(300, -3, frames, lacing)), m.element(m.REFERENCE, 1))))
    data = m.element(m.EBML) + body
    got = m.parse(data)
    assert got.error is None and [data[o : o + n] for _, _, o, n, _, _ in got.packets] == frames
    assert {(t, n, k) for t, n, _, _, k, _ in got.packets} == {(300, 4_000_000, False)}


def test_unknown_sizes_and_faults():
    inner = m.element(m.CLUSTER_TIME, 5) + m.element(m.SIMPLE_BLOCK, m.block(1, 0, [b"abc"], 0))
    unknown = lambda ident: ident.to_bytes(4, "big") + b"\xff"
    data = m.element(m.EBML) + unknown(m.SEGMENT) + unknown(m.CLUSTER) + inner + unknown(m.CLUSTER) + inner + m.element(m.CUES)
    got = m.parse(data)
    assert (got.clusters, len(got.packets), got.error) == (2, 2, None)
    assert m.parse(data[:-8]).error is not None and m.parse(None).error and m.parse(b"").error and m.parse(b"junk").error
    rng = random.Random(0)
    whole = m.mux(rng.randbytes(576 * 100))
    for _ in range(300):
        broken = bytearray(whole[: rng.randrange(len(whole))])
        if broken:
            broken[rng.randrange(min(200, len(broken)))] = rng.randrange(256)
        m.parse(bytes(broken))


def test_cues_lead_to_clusters():
    data = m.mux(random.Random(1).randbytes(576 * 200))
    media = m.parse(data)
    assert len(media.cues) == media.clusters == 4
    assert all(data[at : at + 4] == m.CLUSTER.to_bytes(4, "big") for _, _, at in media.cues)
    assert [p[1] for p in media.packets] == [k * m.NANOS for k in range(200)]


def test_packet_table_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "é" * 200_000, "c")], "doc_id long, text string, media string")
    stored = m.with_media(docs)
    got = m.digest(stored).collect()
    assert len(got) == 4 and len({tuple(r)[1:] for r in got}) == 2
    table = m.packets(stored, "media", ["doc_id"])
    assert table.where("doc_id = 2").count() == -(-400_000 // 576) and table.where("cued").count() == 3 + -(-695 // 64)
    large = spark.createDataFrame([(2**53 + 1, "x", bytearray(m.mux(b"a" * 576))), (None, "y", bytearray(m.mux(b"b" * 1152)))], "doc_id long, track string, media binary")
    assert sorted(tuple(r) for r in m.packets(large, "media", ["doc_id"]).select("doc_id", "size").na.fill(0).collect()) == [(0, 576), (0, 576), (2**53 + 1, 576)]
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"x"))], "doc_id long, media binary")
    assert m.packets(bad, "media", ["doc_id"]).collect() == []
    assert m.digest(m.with_media(docs.limit(0))).collect() == []
